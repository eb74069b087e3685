from waymark.functions.dates import (format_rfc3339, is_rfc3339, iso_week, iso_year,
                                     parse_rfc3339)
from waymark.functions.names import display_name, normalize_user_id, tags_text
from waymark.functions.probability import bayes, bayes_from_counts, likelihood, yes_ratio
from waymark.functions.variants import (decode_base64_json, equality_key, json_type, let,
                                        member_key)

__all__ = [
    "bayes", "bayes_from_counts", "decode_base64_json", "display_name", "equality_key",
    "format_rfc3339", "is_rfc3339", "iso_week", "iso_year", "json_type", "let",
    "likelihood", "member_key", "normalize_user_id", "parse_rfc3339",
    "tags_text", "yes_ratio",
]
