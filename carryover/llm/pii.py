"""Personal data in free text: locate, type, and replace by typed placeholders.

Anchors come first: one Aho-Corasick automaton finds at-signs in all their spellings,
schemes, digits, street words, identifier labels, and names of the lexicon or endings that
recur among them. Deterministic local parsers then expand each anchor to the true bounds
of an item, however far they are, and validate it; nothing is searched for apart from
anchors. Texts stay in their task; nothing is shuffled. The lexicon is shipped to the
executors, behind a check of its size.

Defined results: null and empty texts have no items; items don't overlap (an e-mail
goes before a number, a number before an address, an address before a name); positions
count code points from 1; rows, ties and repeated texts are all kept; a detection column
that clashes with a key gets the prefix ``pii_``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "id_number", "address", "name")
MAX_LEXICON = 200_000

# Spellings of the at-sign, schemes, street words, identifier labels, file endings.
SCHEMES = ["://", "tel:"]
AT_SIGNS = ["@", "＠", "(at)", "[at]", "{at}", " at "]
STREETS_AFTER = [
    "street", "st.", "st", "road", "rd.", "rd", "avenue", "ave.", "ave", "lane", "ln.", "ln", "drive", "dr.", "court", "ct.",
    "crescent", "close", "row", "way", "place", "square", "terrace", "boulevard", "blvd.", "blvd", "gardens", "grove", "hill", "walk", "mews",
]
STREETS_BEFORE = [
    "via", "viale", "piazza", "corso", "calle", "c/", "avenida", "avda.", "plaza", "paseo", "rua",
    "rue", "boulevard", "avenue", "place", "allée", "chemin", "quai", "impasse",
    "ул.", "улица", "пр.", "проспект", "пер.", "переулок", "пл.", "площадь", "наб.", "бульвар", "шоссе",
]
STREET_ENDINGS = ["straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "gade", "vej", "gatan", "straat", "laan", "ring", "damm", "ufer"]
ID_LABELS = [
    "social security", "soc. sec", "ssn", "ni number", "nino", "national insurance", "tax id", "tax no", "tax number", "steuer-id", "steuernummer", "tin",
    "dni", "nie", "id card", "identity card", "personalausweis", "ausweis", "passport", "passeport", "pasaporte", "reisepass", "паспорт", "снилс", "инн", "护照", "身份证", "証",
]
#: Capitalised words that stand before names without being part of them.
NOT_GIVEN = {
    "the", "this", "that", "in", "on", "at", "my", "our", "her", "his", "their", "your", "a", "an", "each", "every", "one", "dear", "hello", "hi", "hey", "and", "or", "but", "with", "for", "from", "to",
    "dr", "mr", "mrs", "ms", "miss", "prof", "sir", "herr", "frau", "monsieur", "madame", "señor", "señora", "mme", "don", "doña",
    "ask", "call", "ring", "signed", "contact", "emergency", "bitte", "llama", "remember", "dossier", "old", "new", "see", "section", "will", "cc", "bcc", "reply", "fwd", "from",
    "die", "der", "das", "ein", "eine", "el", "la", "los", "las", "le", "les", "un", "une", "chaque", "cada", "via", "calle", "plaza", "avenida", "rue", "place", "boulevard", "avenue", "port", "sankt",
}
NOT_A_HOST = {"the", "a", "an", "this", "that", "my", "our", "your", "its", "each", "every", "some", "one"}
FILE_ENDINGS = {"png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "md", "txt", "zip", "json", "html", "csv", "js", "py", "css"}

_CJK_RANGES = "\u2e80-\u9fff\u3040-\u30ff\uac00-\ud7af\uf900-\ufaff"
_LETTER = rf"[^\W\d_{_CJK_RANGES}]"
_WORD = re.compile(rf"{_LETTER}+(?:['’]{_LETTER}+)*")
_DIGIT = re.compile(r"\d", re.A)
_AUTHORITY_END = re.compile(r"[/?#\s<>\"']|\Z")
_WIDE = re.compile("[！-～]")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?|[A-Za-z0-9\-]+ (?:dot|\(dot\)|\[dot\]|\{dot\}) )+[A-Za-z]{2,24}(?![A-Za-z0-9\-])", re.I)
_DOMAIN_PLAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9\-])")
_DOTS = ["(dot)", "[dot]", "{dot}", " dot "]
_DIGITS = re.compile(r"\d+", re.A)
#: What may follow the first digit of a telephone number.
_NUMBER_REST = re.compile(r"(?:[\d()  ]|[ \-./](?=[\d(]))*", re.A)
_AROUND = " ()-./\xa0\u202f"
#: Digits of the longest telephone number; characters between a label and its number at most.
MOST_DIGITS, LABEL_REACH = 15, 14

_IDS = [
    # pattern, lengths of its first run of digits, characters before it, needs a label before it
    (re.compile(r"(?<![A-Za-z0-9])[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![A-Za-z0-9])", re.A), (2, 4, 6), (2, 3), False),
    (re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", re.A), (3,), (0,), False),
    (re.compile(r"(?<![\w\-.])\d{3} \d{2} \d{4}(?![\w\-]| \d)", re.A), (3,), (0,), False),
    (re.compile(r"(?<![\w\-.+])\d{3} \d{3} \d{3} \d{2}(?![\w\-]| \d)", re.A), (3,), (0,), False),
    (re.compile(r"(?<![\w\-.+])\d{2} \d{3} \d{3} \d{3}(?![\w\-]| \d)", re.A), (2,), (0,), True),
    (re.compile(r"(?<![\w\-.])\d{8}-[A-Z](?![\w\-])", re.A), (8,), (0,), False),
    (re.compile(r"(?<![\w\-.])\d{8}[A-Z](?![\w\-])", re.A), (8,), (0,), False),
    (re.compile(r"(?<![\w\-.])[XYZ]-?\d{7}-?[A-Z](?![\w\-])", re.A), (7,), (1, 2), False),
    (re.compile(r"(?<![\w\-.])[A-Z]\d{8}(?![\w\-])", re.A), (8,), (1,), False),
    (re.compile(r"(?<![\w\-.])[A-Z]{0,2}\d{7,9}(?![\w\-])", re.A), (7, 8, 9), (0, 1, 2), True),
    (re.compile(r"(?<![\w\-.])\d{11}(?![\w\-])", re.A), (11,), (0,), True),
]
_IDS_BY_LENGTH = {n: [(k, p, lead) for k, (p, lengths, leads, _) in enumerate(_IDS) if n in lengths for lead in leads] for n in range(1, 12)}

#: A house number with its letter and comma, and the character before it.
HOUSE_CHARS = 12
_HOUSE = r"\d{1,4}(?: ?[A-Za-z](?![A-Za-z]))?"
_NAME_WORD = r"[A-ZÀ-ÞĀ-ž][\w'’\-]*"
_NOT_AFTER = r"(?<![A-Za-z0-9À-ɏЀ-ӿ\-./,])"
_HOUSE_BEFORE = re.compile(rf"{_NOT_AFTER}({_HOUSE}),? (?:{_NAME_WORD} ){{1,3}}\Z")
_HOUSE_COMMA_BEFORE = re.compile(rf"{_NOT_AFTER}({_HOUSE}),? \Z")
_FRENCH_AFTER = re.compile(rf" (?:de la |de l['’]|de |du |des |d['’])?{_NAME_WORD}")
_LATIN_AFTER = re.compile(rf" (?:{_NAME_WORD}|de |del |della |dei |la |las |los |el )(?: ?(?:{_NAME_WORD}|de |del |la ))*?,? (?:n[.º°o]\.? ?)?{_HOUSE}(?![\w])")
_CYRILLIC_AFTER = re.compile(rf" ?[А-ЯЁA-Z][\w\-]*(?: [А-ЯЁ]?[\w\-]+)?, ?(?:д(?:ом|\.)? ?)?{_HOUSE}(?!\w)", re.I)
_HOUSE_AFTER = re.compile(rf"\.? ?,? ?{_HOUSE}(?![\w\-])")


def _same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _narrow(text: str) -> str:
    """Full-width forms as ASCII, one character each."""
    if text.isascii() or not _WIDE.search(text):
        return text
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text)


class Lexicon:
    """Given and family names, and the affixes that recur among them.

    A word outside the lexicon is name-like if it joins a beginning and an ending that
    each occur in at least ``support`` names of one part.
    """

    def __init__(self, rows: list[tuple[str, str]], support: int = 3) -> None:
        self.part: dict[str, set[str]] = defaultdict(set)
        for part, value in rows:
            if part and value and len(value) > 1:
                for x in re.split(r"[\s\-]+", value):
                    self.part[x.lower()].add(part)
        self.affixes: dict[str, tuple[set[str], set[str]]] = {}
        for part in ("given", "family"):
            words = [w for w, parts in self.part.items() if part in parts]
            heads, tails = Counter(), Counter()
            for w in words:
                for k in range(2, len(w) - 1):
                    heads[w[:k]] += 1
                    tails[w[k:]] += 1
            self.affixes[part] = ({h for h, n in heads.items() if n >= support}, {t for t, n in tails.items() if n >= support and len(t) >= 2})
        self._like: dict[tuple[str, str], bool] = {}

    def anchors(self) -> set[str]:
        """Whole names, and the endings of words that may be family names."""
        return set(self.part) | self.affixes["family"][1]

    def known(self, word: str, part: str) -> bool:
        return part in self.part.get(word, ())

    def other(self, word: str, part: str) -> bool:
        """Known, but as the other part only."""
        parts = self.part.get(word)
        return bool(parts) and part not in parts

    def like(self, word: str, part: str) -> bool:
        key = (word, part)
        if key not in self._like:
            if len(self._like) > 500_000:
                self._like.clear()
            heads, tails = self.affixes[part]
            self._like[key] = any(word[:k] in heads and word[k:] in tails for k in range(2, len(word) - 1))
        return self._like[key]


_AT, _SCHEME, _DIGIT_HIT, _STREET_AFTER, _STREET_BEFORE, _STREET_END, _LABEL, _NAME = (1 << k for k in range(8))


class Finder:
    """Finds all items of a text; built once per task."""

    def __init__(self, lexicon: list[tuple[str, str]]) -> None:
        self.lexicon = Lexicon(lexicon)
        kinds: dict[str, int] = defaultdict(int)
        words = ((AT_SIGNS, _AT), (SCHEMES, _SCHEME), ("0123456789", _DIGIT_HIT), (STREETS_AFTER, _STREET_AFTER), (STREETS_BEFORE, _STREET_BEFORE), (STREET_ENDINGS, _STREET_END), (ID_LABELS, _LABEL), (self.lexicon.anchors(), _NAME))
        for group, kind in words:
            for w in group:
                kinds[w] |= kind
        self.automaton = ahocorasick.Automaton()
        for w, k in kinds.items():
            self.automaton.add_word(w, (len(w), k))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Sorted (start, end, kind), 0-based, end exclusive."""
        if not text:
            return []
        flat = _narrow(text)
        low = _same_length_lower(flat)
        anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        runs: list[int] = []  # where runs of digits begin
        names: list[int] = []  # where words end that may be names
        digit = -2
        for end, (length, kind) in self.automaton.iter(low):
            if kind == _DIGIT_HIT:
                if end != digit + 1:
                    runs.append(end)
                digit = end
                continue
            if kind & _NAME and not low[end + 1 : end + 2].isalpha() and (not names or names[-1] != end + 1):
                names.append(end + 1)
            if kind != _NAME:
                for k in (_AT, _SCHEME, _STREET_AFTER, _STREET_BEFORE, _STREET_END, _LABEL):
                    if kind & k:
                        anchors[k].append((end - length + 1, end + 1))
        taken = bytearray(len(flat))
        items: list[tuple[int, int, str]] = []

        def add(start: int, end: int, kind: str) -> None:
            if start < end and taken.find(1, start, end) < 0:
                taken[start:end] = b"\x01" * (end - start)
                items.append((start, end, kind))

        hosts = [e for s, e in anchors[_SCHEME] if low[s] == ":"]
        for s, e in anchors[_AT]:
            near = bisect_right(hosts, s)
            # user information of a locator is no address
            if near and s < _AUTHORITY_END.search(flat, hosts[near - 1]).start():
                continue
            if span := self._email(flat, low, s, e):
                add(*span, "email")
        if runs:
            for s, e in self._ids(flat, runs, sorted(x for _, x in anchors[_LABEL])):
                add(s, e, "id_number")
            for s, e in self._phones(flat, runs, taken, {e for s, e in anchors[_SCHEME] if low[s] == "t"}):
                add(s, e, "phone")
            for s, e in self._addresses(flat, low, anchors):
                add(s, e, "address")
        for s, e in self._names(flat, low, names):
            add(s, e, "name")
        return sorted(items)

    @staticmethod
    def _email(flat: str, low: str, s: int, e: int) -> tuple[int, int] | None:
        sign = low[s:e]
        if sign == "@":
            if not (s and flat[s - 1].isascii() and flat[s - 1].isalnum()):
                return None
            start = _local_start(flat, s)
            d = _DOMAIN_PLAIN.match(flat, e) or _DOMAIN.match(flat, e)
        else:
            start = _spelled_start(flat, low, s)
            if start < 0:
                return None
            after = e
            while after < len(flat) and flat[after] == " ":
                after += 1
            d = _DOMAIN.match(flat, after)
            if sign == " at " and not (d and " dot " in low[d.start() : d.end()] and low[d.start() : d.end()].split()[0] not in NOT_A_HOST):
                return None
        if not d or not any(c.isalpha() for c in d[0].split(".")[0]):
            return None
        if re.sub(r".*[.\s)\]}]", "", d[0]).lower() in FILE_ENDINGS or re.match(r"\d+x\.", d[0]):
            return None
        return start, d.end()

    @staticmethod
    def _ids(flat: str, runs: list[int], labels: list[int]) -> Iterator[tuple[int, int]]:
        """Numbers whose first run of digits is an anchor; shapes that come first win."""
        found = set()
        for d in runs:
            for shape, pattern, lead in _IDS_BY_LENGTH.get(_DIGITS.match(flat, d).end() - d, ()):
                if d >= lead and (m := pattern.match(flat, d - lead)):
                    near = bisect_right(labels, m.start())
                    if not _IDS[shape][3] or near > 0 and m.start() - labels[near - 1] <= LABEL_REACH:
                        found.add((shape, m.start(), m.end()))
        return ((s, e) for _, s, e in sorted(found))

    @staticmethod
    def _phones(flat: str, runs: list[int], taken: bytearray, schemes: set[int]) -> Iterator[tuple[int, int]]:
        word = lambda k: k >= 0 and flat[k].isascii() and (flat[k].isalnum() or flat[k] == "_")
        at = 0
        for d in runs:
            if d < at:
                continue
            s = d - 1 if d and flat[d - 1] in "+(" and not word(d - 2) else d
            if word(s - 1):
                continue
            at = _NUMBER_REST.match(flat, d + 1).end()
            raw = _first_digits(flat, s, at).rstrip(_AROUND)
            if taken[s] or (s and flat[s - 1] in "#№.,/-:@=&%" and raw[:1] not in "+(" and s not in schemes):
                continue
            if raw.startswith("(") and raw.count("(") > raw.count(")"):
                raw, s = raw[1:], s + 1
            used = taken.find(1, s, s + len(raw))
            if used >= 0:  # an item follows
                raw = raw[: used - s].rstrip(_AROUND)
            while raw and not _is_phone(raw):  # a postcode or another number may follow
                raw = raw.rpartition(" ")[0].rstrip(_AROUND)
            if raw:
                yield s, s + len(raw)
                at = s + len(raw)

    @staticmethod
    def _addresses(flat: str, low: str, anchors: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
        edge = lambda k: k >= len(flat) or not (flat[k].isalnum() and flat[k].isascii() or "À" <= flat[k] <= "ɏ" or "Ѐ" <= flat[k] <= "ӿ")
        starts = lambda k: k == 0 or edge(k - 1)
        found = []
        for s, e in anchors[_STREET_BEFORE]:
            if not starts(s) or not (edge(e) or flat[e - 1] in "./"):
                continue
            if low[s:e] in ("rue", "boulevard", "avenue", "place", "allée", "chemin", "quai", "impasse"):
                near = max(0, s - HOUSE_CHARS)
                house, after = _HOUSE_COMMA_BEFORE.search(flat[near:s]), _FRENCH_AFTER.match(flat, e)
                if house and after and after[0].strip():
                    found.append((near + house.start(1), after.end()))
                    continue
            if "Ѐ" <= low[s] <= "ӿ":
                m = _CYRILLIC_AFTER.match(flat, e)
            else:
                m = _LATIN_AFTER.match(flat, e) if flat[s].isupper() else None
            if m:
                found.append((s, m.end()))
        for s, e in anchors[_STREET_AFTER]:
            if not edge(e) and flat[e - 1] != "." or s == 0 or flat[s - 1] != " " or not flat[s].isupper():
                continue
            begin = s
            for _ in range(4):  # three words at most stand between the house number and the street word
                begin = max(0, flat.rfind(" ", 0, begin - 1) + 1) if begin > 0 else 0
            begin = max(0, begin - HOUSE_CHARS)
            m = _HOUSE_BEFORE.search(flat[begin:s])
            if m:
                found.append((begin + m.start(1), e))
        for s, e in anchors[_STREET_END]:
            m = _HOUSE_AFTER.match(flat, e)
            if not m or starts(s) and not flat[s].isupper():
                continue
            k = s
            while k and (flat[k - 1].isalpha() and not _cjk(flat[k - 1]) or flat[k - 1] in "-'’" and k > 1 and flat[k - 2].isalpha()):
                k -= 1
            if k == s:  # the street word stands alone: take the name before it
                before = flat.rfind(" ", 0, s - 1) + 1 if s > 1 else 0
                m2 = re.search(rf"{_NAME_WORD} \Z", flat[before:s])
                k = before + m2.start() if m2 else -1
            if k >= 0 and flat[k].isupper():
                found.append((k, m.end()))
        # the longer item wins where two begin alike
        return iter(sorted(set(found), key=lambda x: (x[0], -x[1])))

    def _names(self, flat: str, low: str, ends: list[int]) -> Iterator[tuple[int, int]]:
        lex = self.lexicon
        anchored = set()
        for e in ends:
            a = e
            while a and (_is_letter(flat[a - 1]) or flat[a - 1] in "'’" and a > 1 and _is_letter(flat[a - 2])):
                a -= 1
            if a < e and flat[a].isupper() and (low[a:e] in lex.part or e - a > 4 and lex.like(low[a:e], "family")):
                anchored.add((a, e))
        if not anchored:
            return
        # words of Latin and related scripts; they may touch scripts without spaces
        words = [m.span() for m in _WORD.finditer(flat)]
        hits = [k for k, span in enumerate(words) if span in anchored]
        # the first and last word of the hyphenated run that each word is part of
        left, right = list(range(len(words))), list(range(len(words)))
        joined = [flat[a[1] : b[0]] in ("-", "‐", "‑") and flat[b[0]].isupper() for a, b in pairwise(words)]
        for k, tied in enumerate(joined, 1):
            if tied:
                left[k] = left[k - 1]
        for k in range(len(joined) - 1, -1, -1):
            if joined[k]:
                right[k] = right[k + 1]
        group = lambda k, step: right[k] if step > 0 else left[k]
        parts: dict[tuple[int, int, str], tuple[bool, bool]] = {}

        def is_part(lo: int, hi: int, part: str) -> tuple[bool, bool]:
            """(possible, known) of the words lo..hi as one part of a name."""
            if (lo, hi, part) not in parts:
                ws = [low[a:b] for a, b in words[lo : hi + 1]]
                if any(not flat[a].isupper() or b - a < 2 for a, b in words[lo : hi + 1]):
                    parts[lo, hi, part] = False, False
                else:
                    known = any(lex.known(w, part) for w in ws)
                    parts[lo, hi, part] = known or not all(lex.other(w, part) for w in ws) and any(lex.like(w, part) for w in ws), known
            return parts[lo, hi, part]

        done = -1
        for k in hits:
            if k <= done:
                continue
            lo, hi = group(k, -1), group(k, 1)
            best = None
            # given, perhaps an initial, family
            for first in self._given_starts(lo, flat, words, group):
                g_hi = group(first, 1)
                nxt = g_hi + 1
                gap = lambda i: flat[words[i - 1][1] : words[i][0]]
                if nxt < len(words) and words[nxt][1] - words[nxt][0] == 1 and flat[words[nxt][0]].isupper() and gap(nxt) == " " and nxt + 1 < len(words) and gap(nxt + 1) in (". ", " "):
                    f_lo, f_gap = nxt + 1, " "
                else:
                    f_lo, f_gap = nxt, gap(nxt) if nxt < len(words) else ""
                if f_lo >= len(words):
                    continue
                f_hi = group(f_lo, 1)
                g, f = is_part(first, g_hi, "given"), is_part(f_lo, f_hi, "family")
                if f_gap.isspace() and len(f_gap) <= 2 and f[0] and (g[0] or self._may_be_given(flat, low, words, first, g_hi)):
                    best = (words[first][0], words[f_hi][1], f_hi)
                elif f_gap == ", " and f_lo == nxt:
                    # family, given
                    f2, g2 = is_part(first, g_hi, "family"), is_part(f_lo, f_hi, "given")
                    if f2[0] and g2[0] and not g[1]:
                        end = f_hi
                        best = (words[first][0], words[end][1], end)
                if best and best[0] <= words[hi][0]:
                    break
                best = None
            if best:
                yield best[0], best[1]
                done = best[2]

    def _may_be_given(self, flat: str, low: str, words: list[tuple[int, int]], lo: int, hi: int) -> bool:
        """A capitalised word that is neither a family name nor one that introduces names."""
        a, b = words[lo][0], words[hi][1]
        return b - a > 2 and flat[a].isupper() and flat[a + 1 : b].isalpha() and low[a:b] not in NOT_GIVEN and not self.lexicon.part.get(low[a:b]) and not self.lexicon.like(low[a:b], "family")

    @staticmethod
    def _given_starts(lo: int, flat: str, words: list[tuple[int, int]], group) -> Iterator[int]:  # noqa: ANN001
        """Where a name that holds the words at ``lo`` may begin: before them, or there."""
        if lo > 0:
            prev = lo - 1
            if words[prev][1] - words[prev][0] == 1 and prev > 0 and flat[words[prev][1] : words[lo][0]] in (". ", " "):
                prev -= 1
            if flat[words[prev][0]].isupper():
                yield group(prev, -1)
        yield lo


def _is_letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z" or not c.isascii() and bool(_WORD.match(c))


def _local_start(flat: str, s: int) -> int:
    """Where the run of address characters before ``s`` begins, from its first letter or digit."""
    k = s
    while k and flat[k - 1].isascii() and (flat[k - 1].isalnum() or flat[k - 1] in "._%+-"):
        k -= 1
    while k < s and not flat[k].isalnum():
        k += 1
    return k


def _spelled_start(flat: str, low: str, s: int) -> int:
    """The same where points may be written out; -1 if nothing stands there."""
    k = s - 1 if s and flat[s - 1].isspace() else s
    start = -1
    while True:
        begin = _local_start(flat, k)
        if begin == k:
            return start
        start = begin
        for dot in _DOTS:
            at = next((begin - len(dot) - n for n in (0, 1) if begin >= len(dot) + n and low.startswith(dot + " " * n, begin - len(dot) - n)), -1)
            if at >= 0:
                k = at - 1 if at and flat[at - 1] == " " else at
                break
        else:
            return start


def _first_digits(flat: str, s: int, e: int) -> str:
    """``flat[s:e]``, up to a space before more digits than a telephone number has."""
    for n, m in enumerate(_DIGIT.finditer(flat, s, e)):
        if n == MOST_DIGITS:
            return flat[s : m.start()].rpartition(" ")[0] if flat[m.start() - 1] != " " else flat[s : m.start()]
    return flat[s:e]


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힯"


def _is_phone(raw: str) -> bool:
    """Whether a run of digits and separators is written like a telephone number."""
    digits = re.sub(r"\D", "", raw)
    if not 8 <= len(digits) <= 15:
        return False
    if raw.startswith("+"):
        return digits[0] != "0"
    groups = re.findall(r"\d+", raw)
    if len(groups) == 1:
        return len(digits) >= 10 and digits.startswith("0") and not digits.startswith("000")
    if re.fullmatch(r"\d{4}[\-./]\d{1,2}[\-./]\d{1,2}.*|\d{1,2}[\-./]\d{1,2}[\-./]\d{4}.*|[1-9]\d{0,2}(?:\.\d{1,3}){3}(?:/.*)?", raw):
        return False
    if raw.startswith("00"):
        return len(digits) >= 10 and digits[2] != "0"
    lengths = [len(g) for g in groups]
    if raw.startswith("(0") or digits.startswith("0"):
        return 9 <= len(digits) <= 12 and lengths != [3, 3, 3, 2] and lengths[0] <= 5 and len(groups) <= 5
    if lengths[0] == 1 and digits[0] == "1":
        lengths, digits = lengths[1:], digits[1:]
    return len(digits) == 10 and (lengths == [3, 3, 4] or lengths == [3, 7]) and digits[0] not in "01"


def _lexicon_rows(lexicon: DataFrame) -> list[tuple[str, str]]:
    rows = lexicon.select("name_part", "name_value").where("name_value IS NOT NULL").limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} names")
    return [(r[0], r[1]) for r in rows]


def find_pii(df: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """``keys`` and (pii_kind, start_pos, end_pos) of each item, positions from 1, end inclusive."""
    rows = _lexicon_rows(lexicon)
    names = [f"pii_{n}" if n in keys else n for n in ("pii_kind", "start_pos", "end_pos")]
    src = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))
    schema = T.StructType([*(T.StructField(k, src.schema[i].dataType) for i, k in enumerate(keys)), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(rows)
        for batch in batches:
            at, kind, start, end = [], [], [], []
            for n, value in enumerate(batch.column(len(keys)).to_pylist()):
                for s, e, k in finder.find(value):
                    at.append(n)
                    kind.append(k)
                    start.append(s + 1)
                    end.append(e)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def redact(df: DataFrame, text: str, lexicon: DataFrame, into: str = "redacted") -> DataFrame:
    """``df`` with the column ``into``: the text with each item replaced by ``[KIND]``."""
    rows = _lexicon_rows(lexicon)
    holder: list[Finder] = []

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        if not holder:
            holder.append(Finder(rows))
        return pd.Series([None if v is None or v != v else replace(v, holder[0].find(v)) for v in values], dtype=object)

    return df.withColumn(into, run(F.col(text)))


def replace(text: str, items: list[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end, kind) replaced by its placeholder."""
    out, at = [], 0
    for s, e, kind in items:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])
