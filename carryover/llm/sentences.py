"""Sentence boundaries across languages and scripts, by a finite transducer.

One pattern cuts a document into tokens of a few classes (kinds of words, end marks,
quotes, breaks). The boundary rules are compiled once into the tables of a finite
transducer over these classes, whose output says before which tokens a sentence
begins. Documents follow each other in one stream of tokens, with a reset between them;
the stream is cut into chunks, wherever documents begin and end. Each chunk is evaluated
as a state-transition function (from every state at once), the functions are composed by
a parallel prefix scan, and all chunks then emit their output from their true first state.

Defined results: null, empty and blank documents have no sentences; positions count
code points from 1, end inclusive; repeated documents keep their own ids; output columns
that clash with the id get the prefix ``sentence_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a chunk; characters of whole documents that are looked at together, at least one document.
CHUNK_TOKENS, GROUP_CHARS = 512, 1_000_000

# Abbreviations that don't end a sentence, and those that may.
ABBREVIATIONS = [
    # Latin, English
    "e.g.", "i.e.", "cf.", "vs.", "viz.", "approx.", "ca.", "Fig.", "fig.", "Figs.", "Sec.", "sec.", "chap.", "Chap.", "ch.", "Ch.", "No.", "no.", "Nos.", "p.", "pp.", "vol.", "Vol.", "ed.", "eds.", "Eq.", "eq.", "Ref.", "ref.", "App.", "Ver.", "ver.",
    "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.", "Mt.", "Rev.", "Gen.", "Col.", "Sgt.", "Capt.", "Lt.", "Hon.", "Gov.", "Sen.", "Rep.", "Messrs.", "incl.", "resp.", "est.", "min.", "max.", "al.",
    # German
    "z. B.", "z.B.", "d. h.", "d.h.", "u. a.", "u.a.", "o. ä.", "z. T.", "i. d. R.", "v. a.", "bzw.", "bspw.", "vgl.", "Vgl.", "Nr.", "Abs.", "Abb.", "Kap.", "Bd.", "Art.", "Hr.", "Fr.", "Frl.", "Dipl.", "evtl.", "ggf.", "inkl.", "sog.", "S.", "Str.", "Tel.", "zzgl.",
    # French
    "M.", "MM.", "Mme.", "Mlle.", "env.", "c.-à-d.", "p. ex.", "art.", "éd.", "chap.", "fig.", "n.", "vol.", "av.", "apr.",
    # Spanish
    "Sr.", "Sra.", "Srta.", "Dra.", "Ud.", "Uds.", "aprox.", "p. ej.", "p.ej.", "pág.", "págs.", "núm.", "cap.", "Lic.", "Ing.", "Av.",
    # Russian
    "т. е.", "т.е.", "т. к.", "т.к.", "т. н.", "напр.", "см.", "ср.", "стр.", "рис.", "гл.", "ул.", "им.", "проф.", "г-н.", "тов.", "тыс.", "млн.", "млрд.", "руб.", "п.", "д-р.",
    # Hindi, Arabic
    "डॉ.", "श्री.", "प्रो.", "पृ.", "د.", "أ.", "ص.", "م.",
]
MAY_END = [
    "etc.", "a.m.", "p.m.", "A.M.", "P.M.", "Inc.", "Ltd.", "Co.", "Corp.", "Jr.", "Bros.", "usw.", "u. s. w.", "etw.", "usf.",
    "и т. д.", "и т.д.", "т. д.", "т.д.", "и т. п.", "и т.п.", "т. п.", "т.п.", "и др.", "др.", "гг.", "г.", "आदि.", "إلخ.",
]

MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]

CLASSES = [
    "space", "newline", "blank", "marker", "thai_space",
    "lower", "upper", "digit", "cjk", "caseless", "abbreviation", "may_end",
    "dot", "strong", "wide", "ellipsis", "wide_ellipsis",
    "dq_open", "dq_close", "sq_open", "sq_close", "lq_open", "lq_close", "low_high", "cq_open", "cq_close", "br_open", "br_close", "wbr_open", "wbr_close",
    "inverted", "comma", "other",
]
CODE = {c: k for k, c in enumerate(CLASSES)}

_BREAK = r"(?>\r\n|[\n\r\x0b\x0c\x85  ])"
_MARKER = r"(?:\#{1,6}[^\S\r\n]+|[-*+•‣▪][^\S\r\n]+|\d{1,3}[.)][^\S\r\n]+)(?=\S)"
_THAI = r"(?:(?=[฀-๿])[\p{L}\p{M}])"


@lru_cache(maxsize=1)
def token_pattern() -> regex.Pattern:
    """One alternation; the name of the matching group is the class, or is refined by ``_refine``."""
    # those of one word are looked up after tokenising, see _dotted_word
    dotted = lambda words: "|".join(regex.escape(w).replace(r"\ ", r"[^\S\r\n]?\s?") for w in sorted({x for x in words if " " in x or "." in x[:-1]}, key=len, reverse=True))
    edge = r"(?<![\p{L}\p{M}\p{N}])"
    parts = [
        # the commonest tokens first: plain words, each with a space behind it, as one word and a space, since no rule
        # tells the words behind the first apart; what follows shows that no rule below applies
        r"(?P<pair>(?:(?:[A-Za-z][a-z]*|[А-яё][а-яё]{3,}) )+(?=[^\s฀-๿]))",
        r"(?P<simple>(?:[A-Za-z][a-z]*|[А-яё][а-яё]{3,})(?=[,\n]))",
        r"(?P<gap> (?=[^\s฀-๿]))",
        rf"(?P<blank>{_BREAK}[^\S\r\n]*(?:{_BREAK}[^\S\r\n]*)+)",
        rf"(?P<newline>{_BREAK}[^\S\r\n]*)",
        rf"(?P<thai_space>(?<={_THAI})[^\S\r\n]+(?={_THAI}))",
        r"(?P<space>[^\S\r\n]+)",
        r"(?P<lower>https?://[^\s<>\"”»）)]*[^\s<>\"”»）).,;:!?。]|`[^`\n]+`|[\w.+\-]{1,64}@[\w\-]+(?:\.[\w\-]+)+)",
        rf"(?P<may_end>{edge}(?=\p{{L}}{{1,3}}[.\s])(?:{dotted(MAY_END)})(?![\p{{Ll}}\p{{N}}]))",
        rf"(?P<abbreviation>{edge}(?=\p{{L}}{{1,3}}[.\s])(?:(?:{dotted(ABBREVIATIONS)})(?!\p{{Ll}})|(?:\p{{Lu}}\.)+(?=\s*[\p{{L}}\p{{N}}(,;])|(?:\p{{L}}\.){{2,}})|{edge}\p{{N}}{{1,2}}\.(?=\s(?:{'|'.join(MONTHS)})))",
        r"(?P<digit>\p{N}(?:[\p{N}.,:/\-]*\p{N})?(?:[\p{L}\p{M}](?:[\p{L}\p{M}\p{N}]|\.(?=\p{N}))*)?)",
        r"(?P<word>[\p{L}\p{M}_](?:[\p{L}\p{M}\p{N}_]|['’\-‑/](?=[\p{L}\p{N}_])|\.(?=\p{Ll}(?!\p{Lu})|\p{Lu}{2,4}(?![\p{L}\p{M}]))|(?<=\p{N})\.(?=\p{N}))*)",
        r"(?P<end>[.!?…。！？｡．؟۔।॥]+)",
        r'(?P<dq_open>(?<![^\s(\[{“„«「『（\-–—])"(?=\S)|(?<=[.!?…。！？])"(?=\p{Lu}))',
        r'(?P<dq_close>")',
        r"(?P<sq_open>(?<![^\s(\[\"“])['‘](?=\S))",
        r"(?P<sq_close>['’](?![\p{L}\p{N}]))",
        r"(?P<lq_open>[„«‹‚])",
        r"(?P<low_high>[“])",
        r"(?P<lq_close>[”»›])",
        r"(?P<cq_open>[「『《〈])",
        r"(?P<cq_close>[」』》〉])",
        r"(?P<br_open>[(\[{])",
        r"(?P<br_close>[)\]}])",
        r"(?P<wbr_open>[（［【〔])",
        r"(?P<wbr_close>[）］】〕])",
        r"(?P<inverted>[¿¡])",
        r"(?P<comma>[,;:،؛、，；：%]|[–—](?=\s))",
        r"(?P<other>\S)",
    ]
    return regex.compile("|".join(parts))


_MARKER_AT = regex.compile(_MARKER)
end_mark = regex.compile(r"[.!?…。！？｡．؟۔।॥]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}々〆ー]")
#: words run on across scripts without spaces, so the class is that of their first letter
_KIND: dict[str, int] = {}


def _refine(group: str, text: str) -> int:
    if group == "word":
        c = text[0]
        if len(text) > 1 and c.islower() and text[1].isupper():  # iNotes
            return CODE["upper"]
        k = _KIND.get(c)
        if k is None:
            if _CJK.match(c):
                k = CODE["cjk"]
            elif c.islower():
                k = CODE["lower"]
            else:
                k = CODE["upper"] if c.isupper() or c.istitle() else CODE["caseless"]
            _KIND[c] = k
        return k
    if any(c in "。！？｡।॥" for c in text):
        return CODE["wide"]
    if any(c in "!?؟" for c in text):
        return CODE["strong"]
    if "……" in text:
        return CODE["wide_ellipsis"]
    if "…" in text or len(text) > 1:
        return CODE["ellipsis"]
    return CODE["dot"]


_SIMPLE = {w: CODE["abbreviation"] for w in ABBREVIATIONS} | {w: CODE["may_end"] for w in MAY_END}


def _dotted_word(word: str) -> int | None:
    """The class of a word that is written with a point, if it is an abbreviation; an elided article doesn't matter."""
    code = _SIMPLE.get(word)
    if code is None and word[1:2] in "'’" and word[:1] in "LlDd":
        code = _SIMPLE.get(word[2:])
    return code


def tokens(text: str) -> tuple[list[int], list[int], list[int]]:
    """(classes, starts, ends) of all tokens; a break before a heading or list line is a ``marker``."""
    classes, starts, ends = [], [], []
    if m := _MARKER_AT.match(text, len(text) - len(text.lstrip())):
        classes.append(CODE["marker"])
        starts.append(0)
        ends.append(0)
    newline, blank, marker, lower, upper, space, abbreviation, may_end = (CODE[c] for c in ("newline", "blank", "marker", "lower", "upper", "space", "abbreviation", "may_end"))
    words = {CODE[c] for c in ("lower", "upper", "caseless")}
    for m in token_pattern().finditer(text):
        g = m.lastgroup
        s, e = m.span()
        code = CODE.get(g)
        if code is None:
            if g == "pair":
                classes.append(lower if text[s].islower() else upper)
                starts.append(s)
                ends.append(e - 1)
                s, code = e - 1, space
            elif g == "simple":
                code = lower if text[s].islower() else upper
            elif g == "gap":
                code = space
            elif g == "end" and ends and ends[-1] == s and m[0][0] == "." and classes[-1] in words and (a := _dotted_word(text[starts[-1] : s + 1])) is not None:
                after = text[s + 1 : s + 2]
                if a == abbreviation and not after.islower() or a == may_end and not (after.islower() or after.isnumeric()):
                    classes[-1] = a
                    ends[-1] = s + 1
                    if e == s + 1:
                        continue
                    m = end_mark.match(text, s + 1)  # noqa: PLW2901
                    s += 1
            if code is None:
                code = _refine(g, m[0])
        elif code == newline or code == blank:
            if _MARKER_AT.match(text, e):
                code = marker
        elif code == lower and m[0][0] == "`":
            code = CODE["other"]
        classes.append(code)
        starts.append(s)
        ends.append(e)
    return classes, starts, ends


# --- the rules, as a step function from which the tables are compiled -------------------

_OPEN = {"dq_open": "dq", "sq_open": "sq", "lq_open": "lq", "low_high": "lq", "cq_open": "cq", "br_open": "br", "wbr_open": "wbr"}
_CLOSE = {"dq": ("dq_close", "dq_open"), "sq": ("sq_close",), "lq": ("lq_close", "low_high"), "cq": ("cq_close",), "br": ("br_close",), "wbr": ("wbr_close",)}
_ENDS = {"dot": "dot", "strong": "strong", "wide": "wide", "ellipsis": "ell", "wide_ellipsis": "well"}
_CLOSERS = {"dq_close", "sq_close", "lq_close", "cq_close", "br_close", "wbr_close"}

#: A state is (in a heading or list line, what is pending, open quote or '', it opened the sentence, its last token was an end mark).
START = (False, "brk", "", False, False)


def step(state: tuple, cls: str) -> tuple[tuple, bool]:
    """The next state, and whether a sentence begins at this token."""
    line, pend, quote, opened, ended = state
    if cls == "blank":
        return (False, "brk", "", False, False), False
    if cls == "marker":
        return (True, "brk", "", False, False), False
    if cls == "newline" and line:
        return (False, "brk", "", False, False), False
    if cls == "thai_space" and not quote and not line:
        return (False, "brk", "", False, False), False
    if cls in ("space", "newline", "thai_space"):
        spaced = pend if pend.endswith("_") or pend in ("in", "brk") else pend + "_"
        return (line, spaced, quote, opened, ended), False

    cut = pend == "brk"
    if quote and not cut:
        if cls in _CLOSE[quote]:
            kind = ("s" if opened else "m") + ("b" if quote in ("br", "wbr") else "c" if quote == "cq" else "q")
            return (line, f"close:{kind}" if ended else "in", "", False, False), False
        return (line, "in", quote, opened, cls in _ENDS or (ended and cls in _CLOSERS)), False
    if not cut and not line:
        cut = _cuts(pend, cls)
    if cls in _OPEN:
        return (line, "in", _OPEN[cls], cut, False), cut
    if cls in _ENDS:
        return (line, _ENDS[cls], "", False, False), cut
    if cls == "may_end":
        return (line, "fin", "", False, False), cut
    if not cut and cls in _CLOSERS and pend in ("dot", "strong", "wide", "ell", "well"):
        return (line, pend, "", False, False), False
    return (line, "in", "", False, False), cut


def _cuts(pend: str, cls: str) -> bool:
    base, spaced = pend.rstrip("_"), pend.endswith("_")
    if base == "in" or cls in _CLOSERS or cls == "comma" or cls in _ENDS:
        return False
    # sentences that follow each other without a space
    joined = ("upper", "abbreviation", "may_end", "digit", "cjk", "caseless", "cq_open", "wbr_open", "dq_open", "lq_open", "br_open", "inverted")
    if base.startswith("close:"):
        opened, kind = base[6] == "s", base[7]
        if cls == "lower":
            return False
        if cls == "cjk":
            return opened and kind == "b" or spaced and opened
        if not spaced:
            return cls in ("wbr_open", "cq_open") if kind == "c" else cls in ("upper", "dq_open", "lq_open", "br_open", "wbr_open", "cq_open", "inverted") or kind == "b" and cls == "digit"
        return opened or cls != "caseless"
    if base == "wide":
        return True
    if base == "well":
        return spaced and cls in ("upper", "digit", "inverted", "dq_open", "lq_open", "br_open")
    if not spaced:
        return cls in joined
    if base in ("fin", "ell", "strong"):
        return cls != "lower"
    return True


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) tables over all states reachable from the start."""
    index, todo, rows = {START: 0}, [START], []
    for state in todo:
        row = []
        for cls in CLASSES:
            new, cut = step(state, cls)
            if new not in index:
                index[new] = len(index)
                todo.append(new)
            row.append((index[new], cut))
        rows.append(row)
    return _minimal(np.array([[n for n, _ in r] for r in rows]), np.array([[c for _, c in r] for r in rows], bool))


def _minimal(nxt: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same transducer with states of equal behaviour merged; the start stays state 0."""
    count, part = 0, np.unique(out, axis=0, return_inverse=True)[1].reshape(-1)
    while part.max() + 1 > count:
        count = part.max() + 1
        part = np.unique(np.column_stack([part, part[nxt]]), axis=0, return_inverse=True)[1].reshape(-1)
    first = np.unique(part, return_index=True)[1]
    order = np.argsort(first)  # state 0 is the first of its part, so its part comes first
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    keep = first[order]
    return number[part[nxt[keep]]], out[keep]


def outputs(classes: np.ndarray, chunk: int = CHUNK_TOKENS) -> np.ndarray:
    """Whether a sentence begins at each token."""
    nxt, out = transducer()
    width = len(CLASSES)
    jump, cuts_at = (nxt * width).reshape(-1), out.reshape(-1)  # a state is kept as the place of its row
    count = max(1, -(-len(classes) // chunk))
    cls = np.full(count * chunk, CODE["space"])
    cls[: len(classes)] = classes
    cls = np.ascontiguousarray(cls.reshape(count, chunk).T)
    # each chunk as a function of its first state
    f = np.tile(np.arange(len(nxt)) * width, (count, 1))
    for j in range(chunk):
        f = jump.take(f + cls[j][:, None])
    state = prefix_states(f // width) * width
    cuts = np.empty(cls.shape, bool)
    for j in range(chunk):
        at = state + cls[j]
        cuts[j] = cuts_at.take(at)
        state = jump.take(at)
    return cuts.T.reshape(-1)[: len(classes)]


def prefix_states(f: np.ndarray) -> np.ndarray:
    """The first state of each chunk, by composing all chunk functions in log2(n) rounds."""
    scan, shift = f.copy(), 1
    while shift < len(scan):
        later = scan.copy()
        later[shift:] = np.take_along_axis(scan[shift:], scan[:-shift], axis=1)
        scan, shift = later, shift * 2
    return np.concatenate([[0], scan[:-1, 0]])


_IS_SPACE = np.isin(np.arange(len(CLASSES)), [CODE[c] for c in ("space", "newline", "blank", "marker", "thai_space")])


def split_all(texts: list[str], chunk: int = CHUNK_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each sentence of all texts, 0-based, end exclusive, without outer spaces."""
    classes, starts, ends, sizes = [], [], [], []
    for text in texts:
        c, s, e = tokens(text)
        classes += [*c, CODE["blank"]]  # a blank line brings the transducer back to its start
        starts += [*s, len(text)]
        ends += [*e, len(text)]
        sizes.append(len(c) + 1)
    cls = np.array(classes, np.int64)
    cuts = outputs(cls, chunk)
    kept = np.flatnonzero(~_IS_SPACE[cls])  # the first of them in each text begins a sentence
    begins = np.flatnonzero(cuts[kept])
    last = np.append(begins[1:], len(kept))[: len(begins)] - 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    return owner[kept[begins]], np.array(starts, np.int64)[kept[begins]], np.array(ends, np.int64)[kept[last]]


def split(text: str, chunk: int = CHUNK_TOKENS) -> list[tuple[int, int]]:
    """(start, end) of each sentence of one text."""
    _, start, end = split_all([text], chunk)
    return list(zip(start.tolist(), end.tolist(), strict=True))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about GROUP_CHARS characters."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def sentences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bodies: bool = True) -> DataFrame:
    """(doc_id, sentence_no, start_pos, end_pos, sentence): each sentence of each document.

    Without ``bodies`` the text of the sentences is left out.
    """
    names = [f"sentence_{n}" if n == doc_id else n for n in ("sentence_no", "start_pos", "end_pos", "sentence")]
    src = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField(doc_id, src.schema["d"].dataType), *(T.StructField(n, T.LongType()) for n in names[:3]), *([T.StructField(names[3], T.StringType())] if bodies else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _groups(texts):
                owner, start, end = split_all(texts[lo:hi])
                no = np.arange(len(owner)) - np.searchsorted(owner, owner)
                body = [pa.array([texts[lo + k][s:e] for k, s, e in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string())] if bodies else []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + owner)), pa.array(no), pa.array(start + 1), pa.array(end), *body], names=schema.names)

    return src.mapInArrow(run, schema)
