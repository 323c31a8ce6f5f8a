"""Mixing sources to target shares of tokens, by entropy balancing.

Documents are sized with a public tokenizer. The wanted tokens of each source are
constraints; among all rates that meet them, those closest to one copy per document (in
relative entropy, with each rate at most the source's cap) are exponentially tilted by
document length: rate = min(cap, exp(lambda * tokens / mean)). The convex dual has one
variable per source; each Newton step for all of them is one distributed aggregation
over the histogram of (source, tokens). Rates become whole copies by systematic rounding
along small cells in order of length, so no source is ever sorted or gathered whole.

Defined results: sources are compared trimmed and in lower case; documents of null or
unlisted sources and documents without tokens aren't chosen; shares of sources without
documents are spread over the others in proportion, and reported; without
``total_tokens`` the total is the largest at which every source meets its share within
its cap; with a larger one, sources at their cap fall short, which the report shows;
repeated targets of one source count as the first in order of share; repeated documents
are mixed each under their own id.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How text is split before merging (fixed value of the rank files).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_SOURCES = 10_000
#: Documents of one source that are put in order together, about, and the parts of a copy that rates are rounded to.
CELL, PARTS = 10_000, 1_000_000


def load_tokenizer(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, doc_id: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(d, source, n_tokens): the id as ``d``, the source trimmed and in lower case."""
    src = df.select(F.col(doc_id).alias("d"), F.lower(F.trim(F.regexp_replace(F.col(source), r"\s+", " "))).alias("s"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField("d", src.schema["d"].dataType), T.StructField("source", T.StringType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


class Plan:
    """Targets, rates and what they came from; small, on the driver."""

    def __init__(self, documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = 17) -> None:
        #: the id's name in results, prefixed where it clashes
        self.doc_id = f"doc_{doc_id}" if doc_id in ("source", "n_tokens", "rate", "copies") else doc_id
        self.seed = seed
        wanted = targets.where("source IS NOT NULL AND target_share IS NOT NULL").select(F.lower(F.trim("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("cap"))
        rows = wanted.orderBy(F.desc("target_share"), "source").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.share: dict[str, float] = {}
        self.cap: dict[str, int] = {}
        for r in rows:
            self.share.setdefault(r[0], float(r[1]))
            self.cap.setdefault(r[0], max(0, int(r[2])))
        listed = F.col("source").isin(list(self.share)) if self.share else F.lit(False)
        # every later step reads the sizes: keep them, three narrow columns, in the shared folder
        self.docs = cut(sized(documents, doc_id, text, source, tokenizer).where(listed & (F.col("n_tokens") > 0)))
        self.lengths = cut(self.docs.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
        have = {r[0]: (r[1], r[2]) for r in self.lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")), F.sum("n")).collect()}
        self.tokens = {s: float(have.get(s, (0, 0))[0]) for s in self.share}
        self.mean = {s: have[s][0] / have[s][1] for s in have}
        self.count = {s: have[s][1] for s in have}
        usable = {s: p for s, p in self.share.items() if p > 0 and self.tokens[s] > 0 and self.cap[s] > 0}
        whole = sum(usable.values())
        self.goal = {s: p / whole for s, p in usable.items()}
        if total_tokens is None:
            total_tokens = min((self.cap[s] * self.tokens[s] / p for s, p in self.goal.items()), default=0.0)
        self.wanted = {s: p * total_tokens for s, p in self.goal.items()}
        self.tilt = self._solve()

    def _solve(self, rounds: int = 60, close: float = 1e-9) -> dict[str, float]:
        """The dual variable of each source; infinite where it needs its whole cap."""
        full = {s: self.cap[s] * self.tokens[s] for s in self.goal}
        tilt = {s: math.inf if self.wanted[s] >= full[s] * (1 - 1e-12) else 0.0 for s in self.goal}
        low, high = dict.fromkeys(tilt, -1e3), dict.fromkeys(tilt, 1e3)
        open_ = {s for s, x in tilt.items() if x == 0.0}
        for _ in range(rounds):
            if not open_:
                break
            got = {r[0]: (r[1], r[2]) for r in self._moments({s: tilt[s] for s in open_}).collect()}
            for s in list(open_):
                value, slope = got[s]
                gap = self.wanted[s] - value
                if abs(gap) <= close * self.wanted[s]:
                    open_.discard(s)
                    continue
                if gap > 0:
                    low[s] = tilt[s]
                else:
                    high[s] = tilt[s]
                step = tilt[s] + gap / slope if slope > 0 else math.inf
                # a step out of the bracket is replaced by bisection
                tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
        if open_:
            raise ValueError(f"no rates meet the targets of {sorted(open_)} after {rounds} rounds")
        return tilt

    def _rate(self, tilt: dict[str, float]):  # noqa: ANN202
        per = F.create_map(*(F.lit(x) for s, v in tilt.items() for x in (s, float(v) if math.isfinite(v) else 1e3)))
        mean = F.create_map(*(F.lit(x) for s in tilt for x in (s, float(self.mean[s]))))
        cap = F.create_map(*(F.lit(x) for s in tilt for x in (s, float(self.cap[s]))))
        at = F.col("n_tokens") / F.try_element_at(mean, F.col("source"))
        raw = F.exp(F.least(F.try_element_at(per, F.col("source")) * at, F.lit(300.0)))
        top = F.try_element_at(cap, F.col("source"))
        full = [s for s, v in tilt.items() if not math.isfinite(v)]
        return (F.when(F.col("source").isin(full), top) if full else F.when(F.lit(False), top)).otherwise(F.least(raw, top)), raw < top, at

    def _moments(self, tilt: dict[str, float]) -> DataFrame:
        """(source, tokens at these rates, their derivative)."""
        rate, inside, at = self._rate(tilt)
        tokens = F.col("n") * F.col("n_tokens")
        return self.lengths.where(F.col("source").isin(list(tilt))).groupBy("source").agg(F.sum(tokens * rate).alias("v"), F.sum(F.when(inside, tokens * rate * at).otherwise(0.0)).alias("g"))

    def chosen(self) -> DataFrame:
        """(doc_id, source, n_tokens, rate, copies) of each chosen document."""
        if not self.goal:
            return self.docs.where("false").select(F.col("d").alias(self.doc_id), "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).cast("bigint").alias("copies"))
        rate, *_ = self._rate(self.tilt)
        # documents of a source are put into cells of bounded size by hash; along each cell, in order of
        # length, copies are dealt out where the running sum of rates passes a whole number, in exact integers
        cells = F.create_map(*(F.lit(x) for s in self.goal for x in (s, math.ceil(self.count[s] / CELL))))
        docs = self.docs.where(F.col("source").isin(list(self.goal)))
        docs = docs.withColumns({"rate": rate, "_cell": F.pmod(F.xxhash64(F.lit(self.seed + 1), "d"), F.try_element_at(cells, F.col("source"))), "_order": F.xxhash64(F.lit(self.seed), "d")})
        parts = F.round(F.col("rate") * PARTS).cast("bigint")
        along = Window.partitionBy("source", "_cell").orderBy("n_tokens", "_order", "d").rowsBetween(Window.unboundedPreceding, 0)
        start = F.pmod(F.xxhash64(F.lit(self.seed + 2), "source", "_cell"), F.lit(PARTS))
        docs = docs.withColumn("_parts", parts).withColumn("_end", F.sum("_parts").over(along) + start)
        whole = lambda x: F.expr(f"({x}) div {PARTS}")
        return docs.withColumn("copies", whole("_end") - whole("_end - _parts")).where("copies > 0").select(F.col("d").alias(self.doc_id), "source", "n_tokens", "rate", "copies")

    def report(self) -> DataFrame:
        """(source, target_share, feasible_share, actual_share, max_repeats, most_copies, documents, copies, tokens) of each listed source."""
        got = self.chosen().groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
        listed = self.docs.sparkSession.createDataFrame([(s, p, self.goal.get(s, 0.0), self.cap[s]) for s, p in self.share.items()], "source string, target_share double, feasible_share double, max_repeats int")
        all_ = listed.join(F.broadcast(got), "source", "left")
        total = got.agg(F.sum("tokens").alias("all_tokens"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        return all_.join(F.broadcast(total)).select("source", "target_share", "feasible_share", (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), "max_repeats", zero("most_copies"), zero("documents"), zero("copies"), zero("tokens"))
