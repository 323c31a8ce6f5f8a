from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from carryover.llm import neardup as nd
from tests.conftest import rows

WORDS = [f"{a}{b}" for a in ("kor", "pel", "vex", "lum", "tri", "sna", "oph", "hex") for b in ("dine", "wick", "max", "lis", "phy", "tun", "gen", "rix", "que", "ban")]


def jaccard(a, b, w=5):
    p, q = ({t[k : k + w] for k in range(len(t) - w + 1)} for t in (a, b))
    return len(p & q) / max(1, len(p | q))


def brute(data, threshold, min_chars):
    import regex

    texts = {}
    for i, t in data:
        if t is not None and i is not None:
            n = regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip()
            if len(n) >= min_chars:
                texts.setdefault(i, set()).add(n)
    ids, out = sorted(texts), set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x == y or jaccard(x, y) >= threshold for x in texts[a] for y in texts[b]):
                out.add((a, b))
    return sorted(out)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    data = []
    for k in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(14, 40))]
        data.append((f"d{k}", " ".join(base)))
        for c in range(rng.choice([0, 0, 1, 2, 3])):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.pop(at), lambda: copy.insert(at, rng.choice(WORDS)), lambda: copy.__setitem__(at, copy[at][::-1]), lambda: rng.shuffle(copy)])()
                if len(copy) < 5:
                    break
            data.append((f"d{k}c{c}", ", ".join(copy).upper() if c else "\n".join(copy)))
    return data


def frame(spark, data):
    return spark.createDataFrame(data, "t string, content string").withColumn("d1", F.lit("clash"))


def test_against_brute_force(spark):
    data = corpus() + [("x1", None), (None, data_text := "korwick pelmax vexlis " * 5), ("x2", data_text), ("x3", data_text), ("x3", data_text), ("x4", "short"), ("x5", ""), ("x6", "… — !! " * 30)]
    src = nd.texts(frame(spark, data), "content", "t", 40)
    for threshold in (0.6, 0.8):
        got = rows(nd.id_pairs(nd.links(src, threshold), src))
        assert got == brute(data, threshold, 40)


def test_given_tables_have_full_recall(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/canonical_record.parquet")
    data = [tuple(r) for r in docs.select("canonical_id", "content").collect()]
    src = nd.texts(docs, "content", "canonical_id", 40)
    assert rows(nd.id_pairs(nd.links(src), src)) == brute(data, 0.6, 40)


def test_hot_group_of_copies_is_indexed_once(spark):
    data = [(f"h{k}", "the very same long text that everybody has copied around") for k in range(600)] + [("n", "the very same long text that everybody has copied about")]
    src = nd.texts(frame(spark, data), "content", "t", 40)
    found = nd.links(src)
    assert found.count() == 1
    got = nd.classes(found, src)
    assert got.count() == 601 and got.select("class_id").distinct().count() == 1
    assert rows(got.select("n_links").distinct()) == [(1,)]


def test_classes_are_components(spark):
    words = [f"word{k:03d}x" for k in range(60)]
    chain = [(f"c{k}", " ".join(words[k : k + 40])) for k in range(0, 20, 4)]  # neighbours alike, ends apart
    data = chain + [("solo", "something else entirely that has no likeness to the others")]
    src = nd.texts(frame(spark, data), "content", "t", 40)
    got = dict(nd.classes(nd.links(src, 0.7), src).select("i", "class_id").collect())
    assert len({got[i] for i, _ in chain}) == 1 and got["solo"] != got["c0"]


def test_empty_and_long(spark):
    src = nd.texts(frame(spark, []), "content", "t", 40)
    assert nd.links(src).count() == 0 and nd.classes(nd.links(src), src).count() == 0
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefghij ", k=300_000))
    src = nd.texts(frame(spark, [("a", long), ("b", "x" + long), ("c", long[:1000])]), "content", "t", 40)
    assert rows(nd.id_pairs(nd.links(src), src)) == [("a", "b")]


def test_hashes_and_bounds():
    a, b = nd.token_hashes(["abcdefg", "xx", "", "abcdefg"], 5)[::3]
    assert np.array_equal(a, b) and len(a) == 3
    assert [len(x) for x in nd.token_hashes(["abcde", "éa𝄞bc", "ab"], 5)] == [1, 1, 0]


def test_parameters(spark):
    data = corpus(9, 60)
    src = nd.texts(frame(spark, data), "content", "t", 40)
    assert rows(nd.id_pairs(nd.links(src, 0.8, miss=0.05, deviations=float("inf")), src)) == brute(data, 0.8, 40)


def test_orders_follow_the_worst_case():
    table = np.zeros(1 << 22, np.uint32)
    ix = nd.Indexer(table, 10**9, 0.6, 20.0, 1e-2)
    common, rare = np.full(100, np.log(10**9) - np.log(5 * 10**8)), np.full(100, 18.0)
    assert ix.worst(rare) < 1.6 and ix.worst(common) == nd.MAX_COMBINATION
    for k in (1.0, 2.5, 4.0, 8.0):  # half of the orders prefer rare tokens and come on top
        assert (1 - 0.6**k) ** (ix.orders(k) / 2) <= 1e-2 < (1 - 0.6**k) ** (ix.orders(k) / 2 - 1)
    assert len(ix.seeds) == ix.orders(8.0)


def near(rng, words, share):
    """``words`` with a share of them, spread at random, replaced by words of no other text."""
    return " ".join(w if rng.random() > share else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for w in words)


def strangers(rng, n):
    return [(f"o{k}", " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12))) for k in range(n)]


def test_edits_of_a_text_that_a_third_of_the_rows_repeat(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a, b in zip(rng.choices(WORDS, k=20), rng.choices(WORDS, k=20), strict=True)]
    hot = " ".join(words)
    edits = [t for t in (near(rng, words, rng.uniform(0.1, 0.25)) for _ in range(1500)) if 0.6 <= jaccard(hot, t) <= 0.66][:200]
    src = nd.texts(frame(spark, [(f"h{k}", hot) for k in range(3000)] + strangers(rng, 6000) + [(f"e{k}", t) for k, t in enumerate(edits)]), "content", "t", 40)
    d1 = src.where("i = 'h0'").first()["d1"]
    assert nd.links(src).where((F.col("a1") == d1) | (F.col("b1") == d1)).count() == len(edits) == 200


def test_family_of_different_edits(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a, b in zip(rng.choices(WORDS, k=30), rng.choices(WORDS, k=30), strict=True)]
    family = [(f"f{k}", near(rng, words, rng.uniform(0, 0.16))) for k in range(250)]
    src = nd.texts(frame(spark, family + strangers(rng, 500)), "content", "t", 40)
    # a small bucket needs as many tokens here as the usual one in a large corpus
    assert rows(nd.id_pairs(nd.links(src, bucket=1.0), src)) == brute(family, 0.6, 40)


def test_sketch_margin(spark):
    from math import comb

    sizes = [2, 40, 200, 1000, 100_000]
    limits = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n int").select(nd.sketch_limit(F.col("n"), 0.6)).collect()]
    assert limits == sorted(limits) and sum(comb(256, k) * 0.2**k * 0.8 ** (256 - k) for k in range(int(limits[-1]) + 1, 257)) < 1e-8
    rng = np.random.default_rng(5)
    for n, limit in zip(sizes[1:4], limits[1:4], strict=True):  # pairs at the threshold stay far below the limit
        for _ in range(50):
            union = rng.integers(0, 2**63, round(n / 1.6), dtype=np.uint64)
            own = len(union) - round(0.6 * len(union))
            a, b = union[own // 2 :], np.delete(union, slice(own // 2, own))
            x, y = nd.Indexer.sketch(a), nd.Indexer.sketch(b)
            assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y) < limit


def test_neither_texts_nor_index_rows_go_through_the_driver(spark, tmp_path):
    frame(spark, corpus(2, 40)).write.parquet(str(tmp_path / "t"))  # a file, so that the planner estimates its size
    found = nd.links(nd.texts(spark.read.parquet(str(tmp_path / "t")), "content", "t", 40))
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.toString().count("SortMergeJoin") == 3 and "Broadcast" not in plan.toString()
    assert found.count() > 0


def test_counters_come_to_the_driver_packed(spark, monkeypatch):
    rng = random.Random(8)
    data = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(2000)] + ["the same text"] * 400
    src = spark.createDataFrame([(t,) for t in data], "t string")
    came, whole = [], type(src).toArrow
    monkeypatch.setattr(type(src), "toArrow", lambda df: came.append(whole(df)) or came[-1])
    table, count = nd.frequencies(src, 5)
    slots = (np.concatenate(nd.token_hashes(data, 5)) >> np.uint64(64 - nd.TABLE_BITS)).astype(np.int64)
    assert count == len(data) and np.array_equal(table, np.bincount(slots, minlength=1 << nd.TABLE_BITS))
    assert sum(t.nbytes for t in came) < 4 * np.count_nonzero(table)  # a slot and a number are 16 bytes
