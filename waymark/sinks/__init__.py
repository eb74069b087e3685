from waymark.sinks.documents import analytics_documents
from waymark.sinks.metrics import counter_metrics, prediction_metrics
from waymark.sinks.snapshots import (read_counters, read_facts, read_goals, read_specs,
                                     write_changed_counters, write_counters, write_facts,
                                     write_goals, write_specs)

__all__ = [
    "analytics_documents", "counter_metrics", "prediction_metrics", "read_counters",
    "read_facts", "read_goals", "read_specs", "write_changed_counters",
    "write_counters", "write_facts", "write_goals", "write_specs",
]
