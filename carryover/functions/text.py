"""Text functions as Column expressions. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters with the Unicode property White_Space.
WHITE_SPACE = r"[\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def fold_whitespace(text: Column) -> Column:
    """Words separated by single spaces, without outer spaces."""
    return F.regexp_replace(F.regexp_replace(text, f"{WHITE_SPACE}+", " "), "^ | $", "")


def title(text: Column, fallback: Column, width: int = 80) -> Column:
    """The first line with content, without leading #, at most ``width`` characters, else ``Memory <fallback>``."""
    strip = lambda x: F.regexp_replace(x, rf"\A{WHITE_SPACE}+|{WHITE_SPACE}+\z", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^\t-\r\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"))
    first = strip(F.regexp_replace(strip(F.get(lines, F.lit(0))), r"\A#+", ""))
    return F.coalesce(F.when(first != "", F.substring(first, 1, width)), F.concat(F.lit("Memory "), fallback))


def slug(text: Column, fallback: Column) -> Column:
    """ASCII letters and digits in lower case, other runs as one hyphen; ``note-`` and 12 characters of ``fallback`` if nothing is left."""
    made = F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "-")), F.lit("-"))
    return F.coalesce(F.when(made != "", made), F.concat(F.lit("note-"), F.substring(fallback, 1, 12)))


def escape_pointer(key: Column) -> Column:
    """One segment of a JSON pointer (RFC 6901)."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def calendar_date(text: Column) -> Column:
    """Whether the text is a real ``YYYY-MM-DD`` date (proleptic Gregorian, year 0000 included)."""
    shape = text.rlike(r"\A\d{4}-\d{2}-\d{2}\z")
    y, m, d = (F.substring(text, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce(shape & m.between(1, 12) & (d >= 1) & (d <= last), F.lit(False))


# Source kinds that carry the owner's own statements, those that don't, and the kinds of the record exchange format.
OWNER_KINDS = ["profile", "preference", "instruction"]
PLAIN_KINDS = ["project", "tool"]
KNOWN_KINDS = OWNER_KINDS + PLAIN_KINDS
EXCHANGE_KINDS = {"profile": "identity", "identity": "identity", "instruction": "procedural", "procedural": "procedural", "episodic": "episodic", "working": "working"}


def dna_class(kind: Column) -> Column:
    return F.when(kind.isin(OWNER_KINDS), "dna").otherwise("standard")


def kind_is_inferred(kind: Column) -> Column:
    """Whether the class of a kind is a guess, because the kind is missing or unknown."""
    return F.coalesce(~kind.isin(KNOWN_KINDS), F.lit(True))


def exchange_kind(kind: Column) -> Column:
    out = F.lit("semantic")
    for name, to in EXCHANGE_KINDS.items():
        out = F.when(kind == name, to).otherwise(out)
    return out


def front_matter(text: Column) -> Column:
    """STRUCT(front, body, unclosed): a leading block between ``---`` lines, as it is written.

    An unclosed block leaves the whole text as the body.
    """
    pattern = r"(?s)\A---\r?\n(?:(.*?)\r?\n)??---(?:\r?\n(.*))?\z"
    opened = text.rlike(r"\A---\r?\n")
    closed = text.rlike(pattern)
    return F.struct(
        F.when(opened & closed, F.regexp_extract(text, pattern, 1)).alias("front"),
        F.when(opened & closed, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"),
        (opened & ~closed).alias("unclosed"),
    )


def index_links(text: Column) -> Column:
    """How many lines are list items that begin with a Markdown link."""
    return F.size(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*-\s+\[[^\]]+\]\([^)]+\)"))).cast("bigint")


def rfc3339_text(value: Column) -> Column:
    """Exact time text: RFC 3339 in capitals, Unix seconds (also with a fraction) as UTC, else null.

    Works on decimals and text, so nanoseconds and offsets are kept; calendar dates are
    never made into times.
    """
    clean = F.upper(F.trim(value))
    shaped = clean.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z") & calendar_date(F.substring(clean, 1, 10))
    clock = (F.substring(clean, 12, 2).try_cast("int") < 24) & (F.substring(clean, 15, 2).try_cast("int") < 60) & (F.substring(clean, 18, 2).try_cast("int") < 60)
    number = clean.rlike(r"\A\d{1,11}(\.\d{1,9})?\z")
    seconds = F.when(number, F.split(clean, r"\.")[0]).try_cast("bigint")
    fraction = F.regexp_replace(F.regexp_extract(clean, r"\.(\d+)\z", 1), "0+$", "")
    whole = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(shaped & clock, clean).when(number, F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z")))
