"""Tables kept as sorted runs, and what is built on them."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import goals_of, log_of, random_events
from waymark.operators.counters import counter_totals, single_tag_counts
from waymark.operators.predictions import bayes_predictions
from waymark.storage import new_path
from waymark.streaming import IncrementalFacts, IncrementalPredictions
from waymark.streaming.runs import Runs, latest, summed

ROW = T.StructType([T.StructField("user", T.StringType()), T.StructField("n", T.LongType())])


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def scanned(frame):
    """Rows the scans below ``frame`` have returned, after Parquet's own skipping."""
    frame = frame.select("*")
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.collectToPython()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value()
               for i in range(leaves.size()))


def test_lookups_stay_flat_over_many_batches(spark):
    table = Runs(spark, new_path(spark, "flat"), ROW, ["user"], fan=4)
    asked = spark.createDataFrame([("u7",), ("u1009",)], "user string")
    hashes = [r[0] for r in asked.select(F.xxhash64("user")).collect()]
    read, size = {}, 12_000
    for batch in range(24):
        users = spark.range(batch * size, (batch + 1) * size).select(
            F.concat(F.lit("u"), F.col("id")).alias("user"), F.col("id").alias("n"))
        table.append(users.unionByName(asked.withColumn("n", F.lit(-batch).cast("long"))), batch)
        if batch in (5, 11, 17, 23):
            found = table._rows(table.runs()).where(F.col("_key_hash").isin(hashes))
            read[batch] = scanned(found)
    assert len(table.runs()) <= 8
    assert table.read().count() == 24 * (size + 2)
    assert table.lookup(asked).count() == 2 * 24 + 2
    assert max(read.values()) <= 24 * size / 4  # of 288,000 rows
    assert read[23] <= 3 * max(read[5], 8_000)


@pytest.mark.parametrize("fan", [2, 3])
def test_runs_hold_every_row_of_every_version(spark, fan):
    table = Runs(spark, new_path(spark, "versions"), ROW, ["user"], fan=fan)
    assert rows_of(table.read()) == []
    rows, by_batch = [], {}
    for batch in range(7):
        added = [(None if batch == 3 else f"u{batch % 3}", batch), ("x", 10 * batch)]
        table.append(spark.createDataFrame(added, ROW), batch)
        rows += added
        by_batch[batch] = sorted(rows, key=repr)
        assert rows_of(table.read()) == by_batch[batch]
    assert rows_of(table.read(5)) == by_batch[5]
    asked = spark.createDataFrame([("u1",), (None,), ("none",)], "user string")
    assert rows_of(table.lookup(asked)) == sorted(
        [r for r in rows if r[0] in ("u1", None)], key=repr)
    names = table.versions.entries()
    assert {r["name"] for r in table.runs()} <= set(names)
    assert sum(n.startswith("version") for n in names) == 3


def test_many_keys_meet_the_table_in_a_join(spark, monkeypatch):
    monkeypatch.setattr("waymark.streaming.runs.PUSHED", 1)
    table = Runs(spark, new_path(spark, "join"), ROW, ["user"])
    table.append(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], ROW), 0)
    asked = spark.createDataFrame([("a",), ("c",), ("d",)], "user string")
    assert rows_of(table.lookup(asked)) == [("a", 1), ("c", 3)]


def test_a_failed_or_repeated_batch(spark, monkeypatch):
    table = Runs(spark, new_path(spark, "failed"), ROW, ["user"], fan=2)
    table.append(spark.createDataFrame([("a", 1)], ROW), 0)
    with monkeypatch.context() as broken:
        def fail(number, document):
            raise OSError("lost")

        broken.setattr(table.versions, "publish", fail)
        with pytest.raises(OSError):
            table.append(spark.createDataFrame([("b", 2)], ROW), 1)
    assert rows_of(table.read()) == [("a", 1)]
    for n in (3, 4):  # merged with the first run each time, and replaced
        table.append(spark.createDataFrame([("b", n)], ROW), 1)
        assert rows_of(table.read()) == [("a", 1), ("b", n)]


def test_combined_rows(spark):
    sums = Runs(spark, new_path(spark, "sums"), ROW, ["user"], summed(["user"], "n"), fan=2)
    last = Runs(spark, new_path(spark, "last"), ROW, ["user"], latest(["user"], "n"), fan=2)
    for batch, rows in enumerate([[("a", 5), ("b", None)], [("a", 7)], [("b", None), ("c", 1)],
                                  [("a", None)], [("c", 2)]]):
        for table in (sums, last):
            table.append(spark.createDataFrame(rows, ROW), batch)
    assert rows_of(sums.read()) == [("a", 12), ("b", None), ("c", 3)]
    assert rows_of(last.read()) == [("a", None), ("b", None), ("c", 2)]
    assert rows_of(last.read(3)) == [("a", None), ("b", None), ("c", 1)]


def test_predictions_follow_every_batch(spark):
    """After each batch the kept predictions equal those computed from all facts."""
    base = new_path(spark, "predictions")
    kept = IncrementalPredictions(base)
    handler = IncrementalFacts(base, initial_goals=goals_of(spark, ("default", "e3")), after=kept)
    events = random_events(700, 21)
    for batch in range(4):
        part = events[batch * 175:(batch + 1) * 175]
        log = log_of(spark, part).withColumn("seq", F.col("seq") + batch * 175)
        handler(log, batch)
        totals = counter_totals(handler.facts(spark))
        singles = single_tag_counts(handler.prior(spark))
        full = bayes_predictions(totals, singles)
        found = kept.predictions(spark).read()
        assert full.count() > 0

        def rounded(frame):
            return rows_of(frame.select("namespace", "goal", "event_name",
                                        F.round("bayes", 9).alias("bayes")))

        assert rounded(found) == rounded(full)
