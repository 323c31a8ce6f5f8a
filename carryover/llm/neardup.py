"""Near-duplicate texts by token-combination prefixes, verified exactly.

Two texts are alike when the sets of their character n-grams share at least
``threshold`` of their union. Texts are normalised and identical ones are represented
once, by a 128-bit digest, so copies cost nothing and are never paired in the search.

1. Frequencies of all tokens in different texts are counted into a table of hashed
   counters (2^22, or more for many texts, 2^24 at most). A token that occurs in one
   text can't be shared and leaves the search.
2. Each text is indexed under several token orders. In each it takes its first token
   if that is rare; while the tokens taken so far are so frequent that more than
   ``bucket`` texts would be expected to share them, the prefix is extended, and the
   combination of its tokens is the index key. Half of the orders prefer rare tokens.
3. Texts that share a key, are of compatible size and whose 256-bit sketches don't rule
   the threshold out are candidates; candidates are verified on their whole sets.

Why not one order and a pigeonhole bound: at 0.6 on 5-character tokens a lossless prefix
needs a quarter to two fifths of all tokens, most of them frequent, and meets nearly all
pairs (README, with figures). A pair at similarity s that needs k tokens is met in one
order with probability s^k, so each text takes as many orders as its own worst case
asks for: if all that a partner shares are its most frequent tokens, k follows from
their frequencies (at most MAX_COMBINATION), and the orders from k and ``miss``, the
chance that a pair just at the threshold is lost by the orders that don't prefer rare
tokens; the others come on top. Both texts of a pair take at least the orders that the
pair needs, so ``miss`` holds for rare and frequent tokens, small and large corpora
alike; what grows with frequent tokens is the work, linearly. The tests and the README
give the measured recall against brute force.

Defined results: null texts and texts shorter than ``min_chars`` after normalisation
have no links; a text delivered several times under one id counts once; different ids
with the same text are linked by ``id_pairs``; a null id is an id like any other in the
index but is left out of id pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.session import cut

TABLE_BITS, MOST_TABLE_BITS = 22, 24
#: counters that travel together
BLOCK = 1 << 16
SKETCH_BITS = 256
MAX_COMBINATION = 8
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


_FACTORS = (np.arange(1, 33, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642E) | np.uint64(1)


_SKETCH_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def normalised(text: Column) -> Column:
    """Lower case, each run of characters other than letters and numbers one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def token_hashes(batch: list[str], width: int) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of all its substrings of ``width`` characters, sorted."""
    sizes = np.array([len(t) for t in batch], np.int64)
    codes = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(codes) - width + 1)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(width):  # a multilinear hash over the whole batch at once
        h += codes[k : k + n] * _FACTORS[k % len(_FACTORS)] + np.uint64(k)
    h = _mix(h)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return [np.unique(h[a : max(a, b - width + 1)]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def texts(df: DataFrame, text: str, ident: str, min_chars: int) -> DataFrame:
    """(i, t, d1, d2): the id, the normalised text and its digest."""
    made = df.where(F.col(text).isNotNull()).select(F.col(ident).alias("i"), normalised(F.col(text)).alias("t")).where(F.length("t") >= min_chars)
    return made.withColumns({"d1": F.xxhash64("t"), "d2": F.xxhash64(F.lit("second"), F.col("t"))})


def _packed(counters: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(counters), codec="zstd", asbytes=True)


def _counters(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * BLOCK, codec="zstd", asbytes=True), np.uint32)


def frequencies(src: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """(hashed counters of the tokens of all rows, number of rows): 16 to 64 MB, whatever the corpus.

    Counters travel as compressed blocks: as rows of slot and number they would be four
    times the size of the table, and most of a small driver's heap.
    """
    count = src.count()
    bits = min(MOST_TABLE_BITS, max(TABLE_BITS, (16 * count).bit_length()))
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            hashes = token_hashes(batch.column(0).to_pylist(), width)
            if hashes:
                total += np.bincount((np.concatenate(hashes) >> shift).astype(np.int64), minlength=len(total)).astype(np.uint32)
        blocks = total.reshape(-1, BLOCK)
        for at in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_packed(blocks[at])], pa.binary())], names=["block", "counters"])

    def add(blocks: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint64)
        for packed in blocks.column("counters").to_pylist():
            total += _counters(packed)
        most = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pa.table({"block": blocks.column("block").slice(0, 1), "counters": pa.array([_packed(most)], pa.binary())})

    table = np.zeros(1 << bits, np.uint32)
    # every task gives up to one row per block, so there are no more tasks than the cluster can use
    few = src.select("t").coalesce(4 * src.sparkSession.sparkContext.defaultParallelism)
    kind = "block int, counters binary"
    summed = few.mapInArrow(run, kind).groupBy("block").applyInArrow(add, kind).toArrow()
    for at, packed in zip(summed.column("block").to_pylist(), summed.column("counters"), strict=True):
        table[at * BLOCK : (at + 1) * BLOCK] = _counters(packed.as_py())
    return table, count


class Indexer:
    """Index keys and sketch of one text."""

    def __init__(self, table: np.ndarray, count: int, threshold: float, bucket: float, miss: float) -> None:
        self.table, self.threshold, self.log_miss = table, threshold, np.log(miss)
        self.shift = np.uint64(64 - (len(table).bit_length() - 1))
        self.log_n = np.log(max(count, 2))
        #: how rare the tokens of a key have to be together
        self.need = max(0.0, self.log_n - np.log(bucket))
        most = self.orders(float(MAX_COMBINATION))
        self.seeds = (_mix(np.arange(1, most + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1))

    def orders(self, combination: float) -> int:
        """Orders that a pair at the threshold needs if it shares keys of so many tokens."""
        met = self.threshold**combination
        return 2 if met >= 1 else 2 * int(np.ceil(self.log_miss / np.log1p(-met)))

    def worst(self, rare: np.ndarray) -> float:
        """Tokens in a key if a partner shares the most frequent tokens only."""
        m = min(len(rare), max(1, int(np.ceil(self.threshold * len(rare) - 1e-9))))
        least = np.partition(rare, m - 1)[:m].mean()
        # the last token of a key overshoots what is needed by half of its share
        return min(max(1.0, self.need / least + 0.5), MAX_COMBINATION)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        df = self.table[(hashes >> self.shift).astype(np.int64)]
        kept = df > 1
        if not kept.any():
            return np.zeros(0, np.uint64)
        rare = np.maximum(self.log_n - np.log(np.maximum(df, 1)), 0.05)  # -ln of the share of texts
        orders = self.orders(self.worst(rare))
        h, rare = hashes[kept], rare[kept].astype(np.float32)
        block = max(1, 2_000_000 // len(h))  # long texts take fewer orders at a time
        return np.concatenate([self._keys(h, rare, slice(k, min(k + block, orders // 2)), half) for half in (0, 1) for k in range(0, orders // 2, block)])

    def _keys(self, h: np.ndarray, rare: np.ndarray, which: slice, half: int) -> np.ndarray:
        # one order per row: a product with an odd factor permutes the hashes
        seeds = self.seeds[half::2][which]
        rank = (h >> np.uint64(32)).astype(np.uint32)[None, :] * (seeds >> np.uint64(32) | np.uint64(1)).astype(np.uint32)[:, None]
        top = np.uint32(2**32 - 1)
        if half:  # rare tokens first
            rank = rank.astype(np.float32) * (1 / rare)
            top = np.float32(np.inf)
        rows = np.arange(len(seeds))
        key, left, extended = seeds.copy(), np.full(len(seeds), self.need), np.ones(len(seeds), bool)
        for _ in range(min(MAX_COMBINATION, len(h))):
            at = rank.argmin(axis=1)
            key = np.where(extended, _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ h[at]), key)
            left -= rare[at]
            # extended while too many texts are expected to share the tokens taken so far
            extended &= left > 0
            if not extended.any():
                break
            rank[rows, at] = top
        return key

    @staticmethod
    def sketch(hashes: np.ndarray) -> np.ndarray:
        """One bit of the least hash in each of 256 ranges, as four integers."""
        h = hashes * _SKETCH_FACTOR
        h.sort()
        bins = (h >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        bits = np.zeros(SKETCH_BITS, np.uint8)
        bits[bins[first]] = (_mix(h[first]) & np.uint64(1)).astype(np.uint8)
        return np.packbits(bits).view(">i8").astype(np.int64)


def index_rows(once: DataFrame, table: np.ndarray, count: int, width: int, threshold: float, bucket: float, miss: float) -> DataFrame:
    """(key, u, size, s1 to s4): each text of ``once`` under its keys."""
    shared = once.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexer = Indexer(shared.value, count, threshold, bucket, miss)
        for batch in batches:
            hashes = token_hashes(batch.column(0).to_pylist(), width)
            keys = [indexer.keys(h) for h in hashes]
            take = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            sketches = np.array([Indexer.sketch(h) for h in hashes], np.int64).reshape(-1, 4)[take]
            sizes = np.array([len(h) for h in hashes], np.int32)[take]
            key = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(1).take(pa.array(take)), pa.array(sizes), *(pa.array(np.ascontiguousarray(sketches[:, k])) for k in range(4))], names=["key", "u", "size", "s1", "s2", "s3", "s4"])

    return once.select("t", "u").mapInArrow(run, "key bigint, u bigint, size int, s1 bigint, s2 bigint, s3 bigint, s4 bigint")


def sketch_limit(sizes: Column, threshold: float, deviations: float = 6.0) -> Column:
    """Differing bits that a pair at ``threshold`` exceeds less than once in 100 million times.

    ``sizes`` is the sum of both texts' tokens. Of the ranges that the union fills, at
    most 1 - threshold have different least tokens, and half of those differ in the bit.
    """
    differ = (1 - threshold) / 2
    empty = F.exp(-sizes / ((1 + threshold) * SKETCH_BITS))
    filled = SKETCH_BITS * (1 - empty)
    return 1 + filled * differ + deviations * F.sqrt(filled * differ * (1 - differ) + SKETCH_BITS * empty * (1 - empty) * differ**2)


def candidate_pairs(rows: DataFrame, threshold: float, deviations: float) -> DataFrame:
    """(a, b): pairs of texts that share a key and may reach the threshold.

    The planner sizes what comes from a checkpoint by the columns' types, 20 bytes a
    text, and a text's many index rows as if they were one. By that it would send them
    whole through the driver, so the joins of texts and of index rows are merges.
    """
    # both sides are the rows as they are, so that one exchange serves both and the planner can split hot keys
    a, b = rows.hint("merge").alias("a"), rows.hint("merge").alias("b")
    differ = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in (1, 2, 3, 4)), F.lit(0))
    sizes = (F.col("a.size") >= threshold * F.col("b.size") - 1e-9) & (F.col("b.size") >= threshold * F.col("a.size") - 1e-9)
    near = differ <= sketch_limit(F.col("a.size") + F.col("b.size"), threshold, deviations)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.u") < F.col("b.u")) & sizes & near)
    return met.select(F.col("a.u").alias("a"), F.col("b.u").alias("b")).distinct()


def verified(pairs: DataFrame, once: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a1, a2, b1, b2, similarity) of the pairs that reach the threshold on whole sets."""
    side = lambda name: once.select(F.col("u").alias(name), F.struct("d1", "d2", "t").alias(f"t{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, q = None, set()
        for batch in batches:
            sims = []
            left, right = (batch.column(c).field("t").to_pylist() for c in ("ta", "tb"))
            for x, y in zip(left, right, strict=True):
                if y != last:  # rows come in order of b
                    q, last = {y[k : k + width] for k in range(len(y) - width + 1)}, y
                p = {x[k : k + width] for k in range(len(x) - width + 1)}
                both = len(p & q)
                sims.append(both / max(1, len(p) + len(q) - both))
            keep = pa.array([s >= threshold - 1e-12 for s in sims], pa.bool_())
            cols = [batch.column(c).field(d) for c in ("ta", "tb") for d in ("d1", "d2")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sims, pa.float64())], names=["a1", "a2", "b1", "b2", "similarity"]).filter(keep)

    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("ta", "tb")
    return joined.mapInArrow(run, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")


def links(src: DataFrame, threshold: float = 0.6, width: int = 5, bucket: float = 20.0, miss: float = 1e-2, deviations: float = 6.0) -> DataFrame:
    """(a1, a2, b1, b2, similarity): all links between different texts of ``texts``.

    ``miss`` sets the number of orders, ``deviations`` the margin of the sketches
    (infinite: no filter). Starts the job that counts tokens; the rest is lazy.
    """
    # copies are dropped before they are counted; a text that much of the corpus repeats shrinks map-side
    once = cut(src.groupBy("d1", "d2").agg(F.max("t").alias("t")).withColumn("u", F.monotonically_increasing_id()))
    table, count = frequencies(once, width)
    pairs = candidate_pairs(index_rows(once, table, count, width, threshold, bucket, miss), threshold, deviations)
    return verified(pairs, once, width, threshold)


def id_pairs(found: DataFrame, src: DataFrame) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: all pairs of ids whose texts are linked or the same.

    This spells copies out, as some results ask for; ``classes`` doesn't.
    """
    members = src.where("i IS NOT NULL").select("i", "d1", "d2").distinct()
    shared = members.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2")
    copies = members.join(shared, ["d1", "d2"], "left_semi")
    same = copies.select("d1", "d2", F.col("i").alias("x")).join(copies.select("d1", "d2", F.col("i").alias("y")), ["d1", "d2"]).where("x < y").select("x", "y")
    a = members.select(F.col("i").alias("x"), F.col("d1").alias("a1"), F.col("d2").alias("a2"))
    b = members.select(F.col("i").alias("y"), F.col("d1").alias("b1"), F.col("d2").alias("b2"))
    linked = found.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where("x <> y").select("x", "y")
    return same.union(linked).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def classes(found: DataFrame, src: DataFrame) -> DataFrame:
    """(i, class_id, n_links): one row per id, its class and its links to other texts.

    Classes are the connected components of the links; labels fall to the least digest
    of the class by propagation with pointer jumping, checkpointed in each round.
    """
    edge = lambda x, y: found.select(F.struct(*x).alias("u"), F.struct(*y).alias("v"))
    named = lambda p: (F.col(f"{p}1").alias("d1"), F.col(f"{p}2").alias("d2"))
    edges = cut(edge(named("a"), named("b")).union(edge(named("b"), named("a"))))
    degree = edges.groupBy("u").agg(F.count("*").alias("n_links"))
    label = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")))
    while True:
        near = edges.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        low = label.join(near, "u").select("u", "label", F.least("label", "m").alias("new"))
        jump = label.select(F.col("u").alias("new"), F.col("label").alias("root"))
        step = cut(low.join(jump, "new", "left").select("u", "label", F.least(F.col("new"), F.coalesce("root", "new")).alias("new")))
        changed = step.where("label <> new").limit(1).count()
        label = step.select("u", F.col("new").alias("label"))
        if not changed:
            break
    members = src.select("i", F.struct("d1", "d2").alias("u")).distinct()
    known = label.join(degree, "u")
    name = F.lower(F.concat(F.lpad(F.hex("c.d1"), 16, "0"), F.lpad(F.hex("c.d2"), 16, "0")))
    return (
        members.join(known, "u", "left")
        .select("i", F.coalesce("label", "u").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        .select("i", name.alias("class_id"), "n_links")
    )
