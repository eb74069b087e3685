"""Independent SQL for the registered queries, in the dialect of DuckDB.

The SQL works on the raw tables only. Histories are taken from all events rather than from
first events, and first events from a row number rather than a minimum.
"""

from oracles.analysis_sql import ANALYSIS
from oracles.event_sql import EVENTS
from oracles.flag_sql import FLAGS
from oracles.stream_sink_sql import STREAMS_AND_SINKS

ORACLES: dict[str, str] = {**EVENTS, **ANALYSIS, **FLAGS, **STREAMS_AND_SINKS}
