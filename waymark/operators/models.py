"""A learned goal model whose scores can be merged with the counted predictions."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# An event whose name contains one of these counts as a reached goal.
GOAL_WORDS = ["goal", "paid"]


def is_goal_name(name: Column) -> Column:
    return name.rlike("|".join(GOAL_WORDS))


def goal_model_scores(events: DataFrame, features: int = 1 << 16,
                      iterations: int = 20) -> DataFrame:
    """Logistic regression of "is a goal" on user, namespace and event name.

    Each event has one hashed indicator per field. Equal events are merged into a weight
    before training, so a hot user or event is one row, and the model held by the driver
    has a fixed number of coefficients. Returns the mean score per event name.
    """
    weighted = (events.groupBy("namespace", "event_name", "user_id")
                .agg(F.count("*").cast("double").alias("weight"))
                .withColumn("label", is_goal_name(F.col("event_name")).cast("double")))
    hasher = FeatureHasher(inputCols=["namespace", "event_name", "user_id"],
                           outputCol="features", numFeatures=features)
    hashed = hasher.transform(weighted)
    model = LogisticRegression(maxIter=iterations, regParam=0.01,
                               weightCol="weight").fit(hashed)
    scored = model.transform(hashed).withColumn(
        "p", vector_to_array("probability")[1])
    return (scored.groupBy("namespace", "event_name")
            .agg(F.avg("p").alias("goal_probability"), F.max("label").alias("label")))
