from waymark.sources.csv_events import events_from_lines, read_event_files
from waymark.sources.flag_requests import parse_flag_requests, usage_events
from waymark.sources.flag_specs import parse_flag_specs
from waymark.sources.event_requests import accepted_events, parse_requests, rejected_requests
from waymark.sources.wide import wide_to_events

__all__ = [
    "accepted_events", "events_from_lines", "parse_flag_requests", "parse_flag_specs",
    "parse_requests", "read_event_files", "rejected_requests", "usage_events",
    "wide_to_events",
]
