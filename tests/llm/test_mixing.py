from __future__ import annotations

import os

import pytest

from carryover.llm import mixing
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer files")


def frame(spark, counts):
    data, n = [], 0
    for source, k in counts.items():
        for i in range(k):
            data.append((n, "word " * (3 + (i * 7) % 40), source))
            n += 1
    return data


def test_shares(spark):
    data = frame(spark, {"A ": 900, "b": 300, "c": 60, None: 40, "other": 50}) + [(9000, None, "b"), (9001, "", "b")]
    docs = spark.createDataFrame(data, "copies bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 5), ("gone", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.Plan(docs, targets, doc_id="copies")
    report = {r["source"]: r for r in plan.report().collect()}
    assert set(report) == {"a", "b", "c", "gone"}
    for s, share in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(report[s]["feasible_share"] - share) < 1e-9
        assert abs(report[s]["actual_share"] - share) < 0.004
        assert report[s]["most_copies"] <= report[s]["max_repeats"]
    assert report["gone"]["tokens"] == 0
    chosen = plan.chosen()
    assert chosen.columns == ["doc_copies", "source", "n_tokens", "rate", "copies"]
    assert chosen.where("copies < 1 OR n_tokens < 1").count() == 0
    # the dual's constraints hold before rounding
    for r in chosen.groupBy("source").agg({"*": "count"}).collect():
        assert r[0] in plan.goal
    want = plan.wanted
    got = {r[0]: r[1] for r in plan._moments({s: t for s, t in plan.tilt.items() if t != float("inf")}).collect()}
    for s, v in got.items():
        assert abs(v - want[s]) <= 1e-6 * want[s]
    again = mixing.Plan(docs.repartition(3), targets, doc_id="copies").chosen()
    assert rows(chosen, "doc_copies", "copies") == rows(again, "doc_copies", "copies")


def test_total_beyond_caps(spark):
    docs = spark.createDataFrame(frame(spark, {"a": 200, "b": 20}), "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.Plan(docs, targets, total_tokens=3000)
    report = {r["source"]: r for r in plan.report().collect()}
    assert report["b"]["copies"] == 40 and report["b"]["actual_share"] < 0.5


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.Plan(docs, targets)
    assert plan.chosen().count() == 0 and plan.report().count() == 1
    assert mixing.Plan(docs, targets.limit(0)).report().count() == 0
    one = spark.createDataFrame([(1, "x " * 50_000, "a")], "doc_id bigint, text string, source string")
    assert rows(mixing.Plan(one, targets).chosen(), "copies") == [(2,)]
