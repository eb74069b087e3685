"""Probability formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the smallest divisor of the naive Bayes likelihood.
LIKELIHOOD_FLOOR = 0.1


def bayes(b_given_a: Column, a: Column, b: Column) -> Column:
    return F.try_divide(b_given_a * a, b)


def bayes_from_counts(goal_tag: Column, goal: Column, tag: Column, everyone: Column) -> Column:
    """P(goal | tag) from unique-user counts."""
    return bayes(F.try_divide(goal_tag, goal), F.try_divide(goal, everyone),
                 F.try_divide(tag, everyone))


def yes_ratio(goal_tag: Column, goal: Column) -> Column:
    """Share of the goal's users who had done the event before."""
    return F.try_divide(goal_tag, goal)


def likelihood(yes: Column, no: Column) -> Column:
    return yes / F.greatest(no, F.lit(LIKELIHOOD_FLOOR))
