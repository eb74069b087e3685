"""Complete jobs over given tables."""

from waymark.plans.catalog import REGISTERED, flagship

__all__ = ["REGISTERED", "flagship"]
