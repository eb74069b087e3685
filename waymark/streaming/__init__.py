from waymark.streaming.counts import (changed_counters, latest_snapshot, unique_user_counts,
                                      weekly_user_counts)
from waymark.streaming.first_writes import stream_first_writes
from waymark.streaming.incremental import IncrementalFacts, IncrementalPredictions
from waymark.streaming.runs import Runs
from waymark.streaming.sinks import (REFRESH_INTERVAL, SNAPSHOT_INTERVAL, FlagStream,
                                     forward_events, read_batches, run_available, run_every,
                                     write_append, write_batches)

__all__ = [
    "FlagStream", "IncrementalFacts", "IncrementalPredictions", "REFRESH_INTERVAL", "Runs",
    "SNAPSHOT_INTERVAL", "changed_counters", "forward_events", "latest_snapshot", "read_batches",
    "run_available", "run_every", "stream_first_writes", "unique_user_counts",
    "weekly_user_counts", "write_append", "write_batches",
]
