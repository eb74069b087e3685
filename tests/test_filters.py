"""Bloom filters that grow after they were stored."""

from pyspark.sql import functions as F

from waymark.operators.membership import (PROBE, add_users, in_growing, stage_plans,
                                          store_filters, stored_filters, united)
from waymark.storage import new_path


def users(spark, low, high, event="e", namespace="n"):
    return spark.range(low, high).select(
        F.lit(namespace).alias("namespace"), F.lit(event).alias("event_name"),
        F.col("id").cast("string").alias("user_id"))


def settings(spark, size, probability, kind="bloom_scalable", event="e"):
    return spark.createDataFrame(
        [("n", event, kind, size, probability)],
        "namespace string, event_name string, kind string, size long, error_probability double")


def hits(probes, filters):
    return in_growing(probes, filters).where("member").count()


def test_growth_over_days(spark):
    path = new_path(spark, "days")
    rule = settings(spark, 200, 0.01)
    filters = None
    for day in range(3):  # each day repeats half of the users of the day before
        filters = add_users(filters, users(spark, day * 1000, day * 1000 + 2000), rule)
        store_filters(filters, f"{path}/{day}")
        filters = stored_filters(spark, f"{path}/{day}")
    assert hits(users(spark, 0, 4000), filters) == 4000
    wrong = hits(users(spark, 10_000, 30_000), filters)
    assert wrong <= 200 + 4 * 200 ** 0.5
    stages = {r["stage"]: r for r in stage_plans(filters.stages).collect()}
    assert sorted(stages) == [0, 1, 2, 3, 4]
    total = sum(r["users"] for r in stages.values())
    assert 3900 <= total <= 4000  # those taken for members are not added
    for k, row in stages.items():
        assert row["users"] <= 1.1 * 200 * 2 ** k
        assert row["hashes"] == round(row["bits"] / (1.1 * 200 * 2 ** k) * 0.693147)


def test_adding_the_same_users_changes_nothing(spark):
    rule = settings(spark, 50, 0.01)
    once = add_users(None, users(spark, 0, 300).union(users(spark, 0, 300)), rule)
    path = new_path(spark, "same")
    store_filters(once, path)
    again = add_users(stored_filters(spark, path), users(spark, 0, 300), rule)
    for left, right in ((once.stages, again.stages), (once.words, again.words)):
        assert sorted(map(str, left.collect())) == sorted(
            map(str, right.select(*left.columns).collect()))


def test_filters_of_different_sizes_together(spark):
    left = add_users(None, users(spark, 0, 500), settings(spark, 100, 0.01))
    right = add_users(None, users(spark, 400, 900), settings(spark, 333, 0.002), "other")
    both = united(left, right)
    assert hits(users(spark, 0, 900), both) == 900
    assert hits(users(spark, 5000, 15_000), both) <= 120 + 4 * 120 ** 0.5


def test_fixed_size_saturates(spark):
    rule = settings(spark, 100, 0.01, "bloom_fixed_size")
    small = add_users(None, users(spark, 0, 100), rule)
    full = add_users(None, users(spark, 0, 2000), rule)
    assert full.stages.count() == 1
    probes = users(spark, 10_000, 12_000)
    assert hits(probes, small) < 60 < 1000 < hits(probes, full)


def test_unknown_counters_have_no_members(spark):
    filters = add_users(None, users(spark, 0, 10), settings(spark, 10, 0.01))
    asked = users(spark, 0, 5, event="other").union(users(spark, 0, 5, namespace="m"))
    assert in_growing(asked, filters).columns == [*PROBE, "member"]
    assert hits(asked, filters) == 0


def shuffled_rows(df):
    """Rows that all shuffles of ``df`` write."""
    df.collect()

    def below(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            inner = [node.executedPlan()]
        elif kind.endswith("QueryStageExec"):
            inner = [node.plan()]
        else:
            children = node.children()
            inner = [children.apply(i) for i in range(children.size())]
        written = node.metrics().get("shuffleRecordsWritten")
        return (written.get().value() if written.isDefined() else 0) + sum(map(below, inner))

    return below(df._jdf.queryExecution().executedPlan())


def test_rows_are_moved_once_whatever_the_bits_and_stages(spark):
    """A user or a probe is one row in a shuffle, not one per hash, stage and filter."""
    left = add_users(None, users(spark, 0, 6000), settings(spark, 50, 0.001))
    assert left.stages.count() == 7
    assert shuffled_rows(left.words) < 1.1 * 6000
    right = add_users(None, users(spark, 5000, 9000), settings(spark, 70, 0.001), "other")
    path = new_path(spark, "both")
    store_filters(united(left, right), path)
    found = in_growing(users(spark, 3000, 13_000), stored_filters(spark, path))
    assert shuffled_rows(found) < 1.1 * 10_000
    assert found.where("member").count() >= 6000


def test_stages_of_many_parts(spark):
    path = new_path(spark, "parts")
    filters = add_users(None, users(spark, 0, 60_000), settings(spark, 40_000, 1e-6))
    store_filters(filters, path)
    filters = add_users(stored_filters(spark, path), users(spark, 50_000, 90_000),
                        settings(spark, 40_000, 1e-6))
    parts = {r["stage"]: r["parts"] for r in stage_plans(filters.stages).collect()}
    assert parts == {0: 64, 1: 128}
    assert filters.words.count() == 64 + 128
    assert filters.words.where("length(words) > 4096").count() == 0
    assert hits(users(spark, 0, 90_000), filters) == 90_000
    assert hits(users(spark, 100_000, 200_000), filters) <= 3


def test_an_overfull_filter_is_built_in_pieces(spark):
    """More users of one part than are built at once, and more probes than are read at once."""
    full = add_users(None, users(spark, 0, 150_000), settings(
        spark, 20_000, 0.01, "bloom_fixed_size"))
    halves = [add_users(None, users(spark, *ends), settings(
        spark, 20_000, 0.01, "bloom_fixed_size")) for ends in ((0, 70_000), (70_000, 150_000))]
    words = [{r["part"]: r["words"] for r in f.words.collect()} for f in (full, *halves)]
    assert words[0].keys() == set(range(8))
    for part, found in words[0].items():
        assert found == bytearray(a | b for a, b in zip(words[1][part], words[2][part]))
    few = add_users(None, users(spark, 0, 20), settings(spark, 30, 0.000001))
    assert hits(users(spark, 0, 150_000), few) == 20


def test_probes_without_a_name_or_user(spark):
    filters = add_users(None, users(spark, 0, 10), settings(spark, 10, 0.0001))
    rows = [("n", "e", "3", 1), ("n", "e", "77", 2), (None, "e", "3", 3), ("n", None, "3", None),
            ("n", "e", None, 5), ("n", "x", "3", 6)]
    asked = spark.createDataFrame(rows, "namespace string, event_name string, user_id string, "
                                        "asked int")
    found = in_growing(asked, filters)
    assert found.columns == [*PROBE, "asked", "member"]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(
        str((*row, row[3] == 1)) for row in rows)
    # Users without an id are counted as before, but nobody can ask for them.
    nobody = add_users(None, asked.select(*PROBE), settings(spark, 10, 0.0001))
    assert {r["event_name"]: r["users"] for r in nobody.stages.collect()} == {"e": 3, "x": 1}


def test_ranks_by_range(spark):
    from waymark.operators.counters import ranked_events
    rows = [(n, f"e{i}", "named", None, None, i % 7) for n in ("a", "b") for i in range(300)]
    totals = spark.createDataFrame(rows, "namespace string, event_name string, counter_type string"
                                         ", iso_year int, iso_week int, count long")
    found = {(r["namespace"], r["event_name"]): r["rank"]
             for r in ranked_events(totals).collect()}
    for name in ("a", "b"):
        ordered = sorted((r for r in rows if r[0] == name), key=lambda r: (-r[5], r[1]))
        assert [found[name, r[1]] for r in ordered] == list(range(1, 301))


def test_long_rollouts_in_chunks(spark):
    from waymark.operators.flags import rollout_exposure
    specs = spark.createDataFrame([("x", 0, 3500), ("y", 7, 7), ("z", 9, 3)],
                                  "name string, rollout_start long, rollout_end long")
    found = [(r["name"], r["at"]) for r in rollout_exposure(specs, 1).collect()]
    assert sorted(found) == [("x", at) for at in range(3501)] + [("y", 7)]
