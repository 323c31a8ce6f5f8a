"""Evaluation texts inside a corpus: pigeonhole pieces, then bit-parallel verification.

A passage is a run of ``words`` words of an item (``letters`` letters or digits for
items in scripts without spaces). With an error budget of ``edits``, items are cut into
aligned pieces so short that any passage holds at least ``edits`` + 1 of them whole; by
the pigeonhole principle a passage within the budget keeps one piece intact. One
Aho-Corasick automaton finds the pieces in a document, and Myers' bit-parallel distance
compares the passages around each hit, so only hits are verified.

Items are the small side: they are counted first, and go to the executors in blocks of
at most ``block_bytes`` bytes, each block scanning all documents. Documents never move.

Defined results: null and empty documents or items match nothing; items shorter than a
passage can't be held; repeated items and documents are reported each under their own
id; texts are compared after dropping format characters, NFKC and case folding; an
output that clashes with the document's id column gets the prefix ``item_``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCRIPTLESS = ("zh", "ja")
_RUN = regex.compile(r"[\p{L}\p{N}]+")
_FORMAT = regex.compile(r"\p{Cf}+")
_ASCII_RUN = re.compile(r"[a-z0-9]+")


def normal_words(text: str) -> list[str]:
    """Runs of letters and digits after dropping Cf, NFKC and case folding."""
    if text.isascii():
        return _ASCII_RUN.findall(text.lower())
    return _RUN.findall(unicodedata.normalize("NFKC", _FORMAT.sub("", text)).casefold())


def piece_length(size: int, edits: int) -> int:
    """The longest piece such that any run of ``size`` holds ``edits`` + 1 aligned pieces whole."""
    return max(b for b in range(1, size + 1) if (size - b + 1) // b >= edits + 1 or b == 1)


def myers(pattern: list | str, text: list | str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any part of ``text``, the end of that part)."""
    m = len(pattern)
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph <<= 1  # a match may begin anywhere: no cost at the left end
        mh <<= 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
        if score < best:
            best, at = score, j + 1
    return best, at


@dataclass(slots=True)
class _Item:
    item_id: int
    units: list  # words, or letters and digits


class Scanner:
    """One block of items against any number of documents."""

    def __init__(self, items: list[tuple[int, str, str]], words: int, letters: int, edits: int) -> None:
        self.sizes = {False: words, True: letters}
        self.edits = edits
        self.items: dict[bool, list[_Item]] = {False: [], True: []}
        self.automata: dict[bool, ahocorasick.Automaton | None] = {}
        self.lengths = {dense: piece_length(n, edits) for dense, n in self.sizes.items()}
        for item_id, lang, text in items:
            dense = (lang or "").lower().replace("_", "-").split("-")[0] in SCRIPTLESS
            units = normal_words(text)
            self.items[dense].append(_Item(item_id, list("".join(units)) if dense else units))
        for dense, group in self.items.items():
            length = self.lengths[dense]
            pieces: dict[str, list[tuple[int, int]]] = {}
            for n, item in enumerate(group):
                if len(item.units) < self.sizes[dense]:
                    continue
                for at in range(0, len(item.units) - length + 1, length):
                    piece = item.units[at : at + length]
                    pieces.setdefault("".join(piece) if dense else f" {' '.join(piece)} ", []).append((n, at))
            a = None
            if pieces:
                a = ahocorasick.Automaton()
                for p, where in pieces.items():
                    a.add_word(p, (len(p), where))
                a.make_automaton()
            self.automata[dense] = a

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, longest exact run in units, least edits of a passage) of each item held."""
        words = normal_words(text)
        out = []
        for dense, automaton in self.automata.items():
            if automaton is None:
                continue
            flat = "".join(words) if dense else f" {' '.join(words)} "
            hits: dict[int, set[tuple[int, int]]] = {}
            starts = None
            for end, (length, where) in automaton.iter(flat):
                if starts is None and not dense:
                    starts, at = {}, 0
                    for k, w in enumerate(words):
                        starts[at] = k
                        at += len(w) + 1
                begin = end - length + 1
                unit = begin if dense else starts[begin]
                for n, at in where:
                    hits.setdefault(n, set()).add((at, unit))
            units = flat if dense else words
            for n, found in hits.items():
                item = self.items[dense][n]
                run, least = self._verify(item.units, units, found, self.sizes[dense], self.lengths[dense])
                if least <= self.edits:
                    out.append((item.item_id, run, least))
        return out

    def _verify(self, item: list, doc: list | str, hits: set[tuple[int, int]], size: int, length: int) -> tuple[int, int]:
        """(longest exact run through a hit, least distance of a passage that holds a piece whole)."""
        run, seen = 0, {}
        for at, unit in sorted(hits):
            if at < seen.get(unit - at, 0):  # inside a run that was measured
                continue
            lo = hi = 0
            while at - lo > 0 and unit - lo > 0 and item[at - lo - 1] == doc[unit - lo - 1]:
                lo += 1
            while at + hi < len(item) and unit + hi < len(doc) and item[at + hi] == doc[unit + hi]:
                hi += 1
            seen[unit - at] = at + hi
            run = max(run, lo + hi)
        least, tried = size, set()
        for at, unit in hits:
            for begin in range(max(0, at + length - size), min(at, len(item) - size) + 1):
                if (begin, unit - at) not in tried:
                    tried.add((begin, unit - at))
                    first = unit - (at - begin)
                    least = min(least, myers(item[begin : begin + size], doc[max(0, first - self.edits) : first + size + self.edits])[0])
                    if not least:
                        return run, 0
        return run, least


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    item_lang: str = "lang", words: int = 12, letters: int = 20, edits: int = 1, block_bytes: int = 64_000_000,
) -> DataFrame:
    """(doc_id, item_id, run, edits): documents that hold a passage of an item within ``edits``.

    ``edits`` is the least distance of any passage, ``run`` the longest exact run of
    units through a piece, also where it is longer than a passage. Starts a job that
    reads the items; each block of them is one pass over the documents.
    """
    chosen = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint"), F.col(item_lang).cast("string"), F.col(item_text))
    src = documents.where(F.col(doc_text).isNotNull() & (F.length(doc_text) > 0)).select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"))
    taken = {doc_id}
    names = []
    for n in (item_id, "run", "edits"):
        while n in taken:
            n = f"item_{n}"  # noqa: PLW2901
        names.append(n)
        taken.add(n)
    schema = T.StructType([T.StructField(doc_id, src.schema["d"].dataType), *(T.StructField(n, T.LongType()) for n in names)])

    def scan(block: list[tuple[int, str, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(block, words, letters, edits)
            for batch in batches:
                rows = [(n, *hit) for n, text in enumerate(batch.column(1).to_pylist()) for hit in scanner.find(text)]
                at, *cols = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

        return src.mapInArrow(run, schema)

    blocks: list[list] = [[]]
    size = 0
    for row in chosen.toLocalIterator():
        size += len(row[2].encode()) + 16
        if size > block_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], row[1], row[2]))
    out = scan(blocks[0])
    for block in blocks[1:]:
        out = out.unionByName(scan(block))
    return out
