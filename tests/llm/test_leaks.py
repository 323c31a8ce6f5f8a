from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from carryover.llm import leaks
from tests.conftest import rows


def edit(a, b):
    """Least distance of a to any part of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abc"), max_size=30))
def test_myers(a, b):
    assert leaks.myers(a, b)[0] == edit(a, b)


def test_pieces_hold_by_pigeonhole():
    for size in (5, 12, 20):
        for edits in range(4):
            n = leaks.piece_length(size, edits)
            for offset in range(n):
                first = -(-offset // n) * n
                whole = len([x for x in range(first, offset + size - n + 1, n)])
                assert whole >= edits + 1 or n == 1


def test_normal_words():
    assert leaks.normal_words("Ｆoo­bar, STRASSE ﬁx’s 1½") == ["foobar", "strasse", "fix", "s", "11", "2"]
    assert leaks.normal_words("It's A-b") == ["it", "s", "a", "b"]


VOCAB = [f"w{k}" for k in range(30)]


def brute(docs, items, words=12, letters=20):
    out = set()
    for d, t in docs:
        for i, lang, text in items:
            if not t or not text or i is None:
                continue
            a, b = leaks.normal_words(text), leaks.normal_words(t)
            if lang in ("zh", "ja"):
                a, b, n = "".join(a), "".join(b), letters
            else:
                n = words
            runs = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            if any(tuple(a[k : k + n]) in runs for k in range(len(a) - n + 1)):
                out.add((d, i))
    return sorted(out)


def data(seed=4):
    rng = random.Random(seed)
    items = [(k, rng.choice(["en", "de", None]), " ".join(rng.choices(VOCAB, k=rng.randrange(8, 60)))) for k in range(40)] + [(100 + k, "zh", "".join(rng.choices("一二三四五六七八九十百千", k=rng.randrange(15, 50)))) for k in range(10)] + [(200, "en", None), (201, "en", ""), (0, "en", "repeated id " * 9)]
    docs = []
    for k in range(300):
        words = rng.choices(VOCAB, k=rng.randrange(0, 80))
        i = rng.choice(items)
        if i[2]:
            body = list(i[2]) if i[1] == "zh" else i[2].split()
            n = rng.randrange(8, 26)
            at = rng.randrange(max(1, len(body) - n))
            piece = body[at : at + n]
            words[len(words) // 2 : len(words) // 2] = [("" if i[1] == "zh" else " ").join(piece).upper()]
        docs.append((k % 290, ", ".join(words)))
    return docs + [(900, None), (901, "")], items


def test_against_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "run bigint, text string")
    i = spark.createDataFrame(items, "run bigint, lang string, text string")
    for edits in (0, 1, 2):
        for block in (500, 64_000_000):
            got = leaks.find_leaks(d, i, doc_id="run", item_id="run", edits=edits, block_bytes=block)
            assert len(set(got.columns)) == 4 and got.columns[:2] == ["run", "item_run"]
            held = {(r[0], r[1]) for r in got.collect() if r[3] == 0}
            assert sorted(held) == sorted(set(brute(docs, items)))


def test_edits_are_found(spark):
    passage = [f"p{k}" for k in range(14)]
    i = spark.createDataFrame([(1, "en", " ".join(passage))], "item_id bigint, lang string, text string")
    changed = passage[:6] + ["other"] + passage[7:]
    d = spark.createDataFrame([(1, "so " + " ".join(changed) + " end"), (2, " ".join(passage[:5])), (3, " ".join(passage))], "doc_id bigint, text string")
    assert rows(leaks.find_leaks(d, i), "doc_id", "item_id", "edits") == [(1, 1, 1), (3, 1, 0)]
    assert rows(leaks.find_leaks(d, i, edits=0), "doc_id") == [(3,)]
    assert leaks.find_leaks(d, i.limit(0)).count() == 0 and leaks.find_leaks(d.limit(0), i).count() == 0
    long = d.limit(0).union(spark.createDataFrame([(9, "p1 " * 200_000 + " ".join(passage))], "doc_id bigint, text string"))
    assert rows(leaks.find_leaks(long, i), "doc_id") == [(9,)]


def test_run_is_the_longest(spark):
    words = [f"q{k}" for k in range(60)]
    i = spark.createDataFrame([(1, "en", " ".join(words)), (2, "zh", "一二三四五六七八九十百千万亿甲乙丙丁戊己庚辛")], "item_id bigint, lang string, text string")
    d = spark.createDataFrame([(1, " ".join([*words[3:16], "x", *words[20:55]])), (2, "甲乙丙丁一二三四五六七八九十百千万亿甲乙丙丁戊")], "doc_id bigint, text string")
    assert rows(leaks.find_leaks(d, i)) == [(1, 1, 35, 0), (2, 2, 19, 1)]
