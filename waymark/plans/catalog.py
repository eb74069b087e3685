"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.plans import (analysis_queries, event_queries, flag_queries, sink_queries,
                           stream_queries)

Query = Callable[[SparkSession, str], DataFrame]

REGISTERED: dict[str, Query] = {
    **event_queries.QUERIES,
    **analysis_queries.QUERIES,
    **flag_queries.QUERIES,
    **stream_queries.QUERIES,
    **sink_queries.QUERIES,
}

flagship: Query = analysis_queries.bayes_predictions
