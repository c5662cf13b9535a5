import pytest
from pyspark.sql import functions as F

from lakeweave.operators import history as h
from lakeweave.operators.history import Versioning

V = Versioning(("id",), "t", ("x",), "op")


def events(spark, *given):
    return spark.createDataFrame([(i, t, x, op) for i, t, x, op in given], "id long, t string, x string, op string").withColumn("t", F.col("t").cast("timestamp"))


def story(df):
    return [(r["x"], str(r["s"])[:10], r["e"] and str(r["e"])[:10], r["a"], r["d"]) for r in df.select("x", F.col(h.START).alias("s"), F.col(h.END).alias("e"), F.col(h.ACTIVE).alias("a"), F.col(h.DELETED).alias("d")).orderBy("s").collect()]


def test_first_load_chains_and_collapses(spark):
    df = h.timeline(events(spark, (1, "2024-01-01", "A", "INSERT"), (1, "2024-01-01", "A", "INSERT"), (1, "2024-01-02", "A", "UPDATE"), (1, "2024-01-03", "B", "UPDATE")), V)
    assert story(df) == [("A", "2024-01-01", "2024-01-03", False, False), ("B", "2024-01-03", None, True, False)]


def test_returning_value_keeps_an_active_version(spark):
    first = h.timeline(events(spark, (1, "2024-01-01", "A", "INSERT")), V)
    df = h.applied(first, events(spark, (1, "2024-01-02", "B", "UPDATE"), (1, "2024-01-03", "A", "UPDATE")), V)
    assert story(df) == [("A", "2024-01-01", "2024-01-02", False, False), ("B", "2024-01-02", "2024-01-03", False, False), ("A", "2024-01-03", None, True, False)]


def test_deleted_key_is_idempotent(spark):
    given = events(spark, (1, "2024-01-01", "A", "INSERT"), (1, "2024-01-02", "A", "DELETE"))
    first = h.timeline(given, V)
    assert story(first) == [("A", "2024-01-01", "2024-01-02", False, False), ("A", "2024-01-02", None, False, True)]
    again = h.applied(first, given, V)
    assert story(again) == story(first) and again.where("_new").count() == 0
    assert h.current(first).count() == 0


def test_batching_doesnt_matter(spark):
    given = [(1, "2024-01-01", "A", "I"), (1, "2024-01-02", "A", "U"), (1, "2024-01-03", "B", "U"), (1, "2024-01-04", "A", "U")]
    whole, parts = h.timeline(events(spark, *given), V), h.timeline(events(spark, given[0]), V)
    for e in given[1:]:
        parts = h.applied(parts, events(spark, e), V).drop("_new")
    assert story(parts) == story(whole)


def test_late_and_resent_events_are_told_apart(spark):
    first = h.timeline(events(spark, (1, "2024-01-05", "A", "I")), V)
    df = h.classified(first, events(spark, (1, "2024-01-05", "A", "U"), (1, "2024-01-03", "B", "U"), (1, "2024-01-06", "C", "U"), (2, "2024-01-01", "Z", "I")), V)
    assert {(r["id"], r["x"]): r["_status"] for r in df.collect()} == {(1, "A"): "unchanged", (1, "B"): "late", (1, "C"): "applicable", (2, "Z"): "applicable"}


def test_conflicts_have_one_winner_whatever_the_order(spark):
    a, b = (1, "2024-01-01", "A", "I"), (1, "2024-01-01", "B", "I")
    assert story(h.timeline(events(spark, a, b), V)) == story(h.timeline(events(spark, b, a), V))
    assert h.timeline(events(spark, a, b), V).count() == 1


def test_null_version_is_no_version_and_null_position_counts(spark):
    assert h.timeline(events(spark, (1, None, "A", "I")), V).count() == 0
    two = Versioning(("id",), "t", ("x", "y"))
    rows = spark.createDataFrame([(1, "2024-01-01", None, "q"), (1, "2024-01-02", "q", None)], "id long, t string, x string, y string").withColumn("t", F.col("t").cast("timestamp"))
    assert h.timeline(rows, two).count() == 2


def test_point_in_time(spark):
    df = h.timeline(events(spark, (1, "2024-01-01", "A", "I"), (1, "2024-01-03", "B", "U"), (1, "2024-01-05", "B", "DELETE")), V)
    at = lambda t, **k: [r["x"] for r in h.as_of(df, F.lit(t).cast("timestamp"), **k).collect()]
    assert at("2023-12-31") == [] and at("2024-01-01") == ["A"] and at("2024-01-03") == ["B"]
    assert at("2024-01-06") == [] and at("2024-01-06", include_deleted=True) == ["B"]


@pytest.mark.parametrize("check", [h.many_active, h.inverted, h.gaps])
def test_healthy_history_breaks_no_invariant(spark, check):
    df = h.timeline(events(spark, (1, "2024-01-01", "A", "I"), (1, "2024-01-03", "B", "U"), (2, "2024-01-03", "B", "U")), V)
    assert check(df, ("id",)).count() == 0


def test_empty_events(spark):
    assert h.timeline(events(spark).limit(0) if False else spark.createDataFrame([], "id long, t timestamp, x string, op string"), V).count() == 0
