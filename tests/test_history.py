from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from carryover.operators.dedup import duplicate_key, exact_duplicates, resolve_aliases
from carryover.operators.history import carry_forward, latest_per_chain, merge_latest, violations
from carryover.operators.reconcile import field_differences, three_way
from carryover.operators.relocate import relocation_candidates
from tests.conftest import rows


def test_exact_duplicates(spark):
    data = [("b", "k", 1), ("a", "k", 2), ("c", "k", 1), ("d", None, 1), ("e", "solo", 1), ("b", "k", 1)]
    df = spark.createDataFrame(data, "id string, group_size string, pref int")
    df = df.select("id", F.col("group_size").alias("k"), "pref", F.lit("old").alias("duplicate_of"))
    assert rows(exact_duplicates(df, "id", "k"), "id", "duplicate_of") == sorted([("a", None), ("b", "a"), ("b", "a"), ("c", "a"), ("d", None), ("e", None)], key=repr)
    assert rows(exact_duplicates(df, "id", "k", [F.col("pref")]), "id", "duplicate_of") == sorted([("a", "b"), ("b", None), ("b", None), ("c", "b"), ("d", None), ("e", None)], key=repr)
    assert ("a", None) in rows(exact_duplicates(df, "id", "k", eligible=F.col("id") != "a"), "id", "duplicate_of")
    assert exact_duplicates(df.limit(0), "id", "k").count() == 0


def test_representative_does_not_depend_on_order(spark):
    data = [(f"id{k}", f"k{k % 3}") for k in range(60)]
    expected = None
    for seed in range(3):
        random.Random(seed).shuffle(data)
        got = rows(exact_duplicates(spark.createDataFrame(data, "id string, k string").repartition(seed + 1), "id", "k"), "id", "duplicate_of")
        expected = expected or got
        assert got == expected


def test_duplicate_key_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "b"), ("n", "b"), ("", "b"), ("ab", ""), ("a", "b")], "m string, c string")
    assert df.select(duplicate_key([F.col("m"), F.col("c")], F.lit("x"))).distinct().count() == 5


def test_aliases(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "id string, k string")
    then = spark.createDataFrame([("b", "a"), ("c", "a"), ("a", "gone"), ("x", "a")], "id string, representative string")
    assert rows(resolve_aliases(now, then, "id", "k"), "id", "status") == [("a", "absent"), ("b", "still"), ("c", "changed")]


def test_latest_per_chain(spark):
    df = spark.createDataFrame([("s", 1, "r1"), ("s", 2, "r2"), ("s", 2, "r3"), (None, 1, "r4"), ("t", None, "r5")], "s string, ties int, r string")
    assert rows(latest_per_chain(df, ["s"], [F.col("ties")], ["r"]).select("s", "r", "ties")) == sorted([("s", "r3", 2), (None, "r4", 1), ("t", "r5", 1)], key=repr)
    assert latest_per_chain(df.limit(0), ["s"], [F.col("ties")], ["r"]).count() == 0


def test_carry_merge_violations(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    assert rows(carry_forward(old, new, ["id"])) == [("a", 1, "source_missing")]
    assert rows(merge_latest(old, new, ["id"])) == [("a", 1), ("b", 2), ("c", 2)]
    assert rows(violations(old.union(new), ["id"])) == [("b", 2)]


@pytest.mark.parametrize(
    "p,s,t,outcome",
    [
        ("1", "1", "1", "unchanged"), ("1", "2", "2", "converged"), ("1", "2", "1", "source_changed"), ("1", "1", "2", "target_changed"), ("1", "2", "3", "conflict"),
        (None, "1", None, "new"), (None, None, "1", "target_untracked"), (None, "1", "2", "both_new"), ("1", None, "1", "source_missing"), ("1", "1", None, "deleted_in_target"), ("1", None, None, "gone"),
    ],
)
def test_three_way(spark, p, s, t, outcome):
    side = lambda v: spark.createDataFrame([("k", v)] if v else [], "id string, h string")
    assert rows(three_way(side(p), side(s), side(t), "id", "h"), "outcome") == [(outcome,)]


def test_field_differences(spark):
    a = spark.createDataFrame([("1", "x", None), ("2", "x", "y"), ("3", "x", "y")], "id string, status string, r string")
    b = spark.createDataFrame([("1", "x", None), ("2", None, "z"), ("4", "x", "y")], "id string, status string, r string")
    got = {r[0]: (r[1], list(r[2])) for r in field_differences(a, b, "id", ["status", "r"]).collect()}
    assert got == {"1": ("verified", []), "2": ("mismatch", ["status", "r"]), "3": ("missing", []), "4": ("unexpected", [])}


def test_relocation(spark):
    known = [("old", f"r{k}", "h") for k in range(10)] + [("other", "r1", "h")]
    now = [("new", f"r{k}", "h") for k in range(6)] + [("new", f"n{k}", "h") for k in range(4)] + [("new", None, "h"), ("new", "r0", "h")]
    mk = lambda d: spark.createDataFrame(d, "s string, r string, d string")
    assert rows(relocation_candidates(mk(now), mk(known), "s", "r", "d")) == [("new", "old", 6, 10, 0.6)]
    assert relocation_candidates(mk(now), mk(known), "s", "r", "d", ratio=0.61).count() == 0
