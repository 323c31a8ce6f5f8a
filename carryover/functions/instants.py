"""Mixed timestamp texts to one UTC instant, in JVM expressions only.

All formats are compiled into one regular expression whose alternatives use named
groups. ``regexp_replace`` applies it once per value and lays the components out in a
fixed order; ranges are then checked and the instant is assembled with integer day
arithmetic. Only values without an offset need the time-zone database.

Defined results: null, empty, unparsable, date-only and impossible values give null,
as do local times that never occur and local times without a usable zone. A local
time that occurs twice gives the earlier instant. An abbreviation that the row's zone
never used gives null. Digits finer than a microsecond are cut off.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from importlib.resources import files
from zoneinfo import TZPATH, available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they are written in the accepted formats.
MONTHS_EN = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTHS_EN_FULL = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
MONTHS_DE = [
    "januar", "februar", "märz", "april", "mai", "juni",
    "juli", "august", "september", "oktober", "november", "dezember",
]

EXACT_UTC = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"
ZERO_OFFSET_NAMES = ["UTC", "GMT", "UT", "Z"]

_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_MARK = "\u0001"
_FIELDS = ["y", "m", "b", "d", "p", "q", "h", "i", "s", "f", "k", "o", "r", "a", "e", "g"]


def _month_numbers() -> str:
    numbers = {name: k for names in (MONTHS_EN, MONTHS_EN_FULL, MONTHS_DE) for k, name in enumerate(names, 1)}
    return ",".join(f"{name}:{k}" for name, k in numbers.items())


def _zone(n: int) -> str:
    sp = _SPACE
    return (
        rf"(?:{sp}*(?:(?<o{n}>[+\-\x{{2212}}]\d{{2}}(?::?\d{{2}})?)(?:\[[A-Za-z0-9_/+\-]+\])?"
        rf"|\[?(?<r{n}>[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)\]?|(?<a{n}>[A-Za-z]{{1,5}})))?"
    )


def _clock(n: int, sep: str = ":", short: bool = False) -> str:
    hour = r"\d{1,2}" if short else r"\d{2}"
    return rf"(?<h{n}>{hour}){sep}(?<i{n}>\d{{2}})(?:{sep}(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?"


def _half(n: int) -> str:
    return rf"(?:{_SPACE}*(?<k{n}>[AaPp])\.?[Mm]\.?)?"


@lru_cache(maxsize=1)
def instant_pattern() -> tuple[str, str]:
    """(pattern, replacement): one alternation, and the layout of its components."""
    sp = _SPACE
    en = "|".join(x.capitalize() for x in MONTHS_EN_FULL + MONTHS_EN)
    de = "|".join(x.capitalize() for x in MONTHS_DE)
    alternatives = [
        rf"(?<y1>\d{{4}})-(?<m1>\d{{2}})-(?<d1>\d{{2}})(?:[Tt]|{sp}+){_clock(1)}{_zone(1)}",
        rf"(?<y2>\d{{4}})(?<m2>\d{{2}})(?<d2>\d{{2}})[Tt](?<h2>\d{{2}})(?<i2>\d{{2}})(?:(?<s2>\d{{2}})(?:[.,](?<f2>\d+))?)?{_zone(2)}",
        rf"(?:[A-Z][a-z]{{2}},?{sp}+)?(?<d3>\d{{1,2}}){sp}+(?<b3>{en}){sp}+(?<y3>\d{{4}}),?{sp}+{_clock(3)}{_zone(3)}",
        rf"(?<d4>\d{{1,2}})\.(?<m4>\d{{1,2}})\.(?<y4>\d{{4}}),?{sp}+{_clock(4, short=True)}{_zone(4)}",
        rf"(?<p5>\d{{1,2}})/(?<q5>\d{{1,2}})/(?<y5>\d{{4}}),?{sp}+{_clock(5, short=True)}{_half(5)}{_zone(5)}",
        rf"(?<b6>{en}){sp}+(?<d6>\d{{1,2}}),{sp}*(?<y6>\d{{4}}),?{sp}+{_clock(6, short=True)}{_half(6)}{_zone(6)}",
        rf"(?<d7>\d{{1,2}})\.{sp}*(?<b7>{de}){sp}+(?<y7>\d{{4}}),?{sp}+{_clock(7, short=True)}(?:{sp}*Uhr)?{_zone(7)}",
        rf"(?<y8>\d{{4}})年(?<m8>\d{{1,2}})月(?<d8>\d{{1,2}})日{sp}*{_clock(8, short=True)}{_zone(8)}",
        r"(?<e9>\d{9,20})(?:\.(?<g9>\d+))?",
    ]
    has = {(f, n) for n, a in enumerate(alternatives, 1) for f in _FIELDS if f"(?<{f}{n}>" in a}
    layout = "|".join("".join(f"${{{f}{n}}}" for n in range(1, 10) if (f, n) in has) for f in _FIELDS)
    return rf"\A{sp}*(?:{'|'.join(alternatives)}){sp}*\z", f"{_MARK}{layout}"


def _zone_file(zone: str) -> bytes:
    for root in TZPATH:
        path = os.path.join(root, zone)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    return files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()


def zone_names(data: bytes) -> dict[str, list[int]]:
    """Abbreviation -> offsets in seconds that it stood for, the latest first, of a TZif file (RFC 8536)."""

    def block(at: int, width: int) -> tuple[int, list, list, bytes]:
        utc, std, leap, times, types, chars = struct.unpack_from(">6l", data, at + 20)
        at += 44
        when = struct.unpack_from(f">{times}{'q' if width == 8 else 'l'}", data, at)
        which = data[at + times * width : at + times * (width + 1)]
        at += times * (width + 1)
        kinds = [struct.unpack_from(">lbB", data, at + 6 * k) for k in range(types)]
        at += types * 6
        return at + chars + leap * (width + 4) + std + utc, list(zip(when, which, strict=True)), kinds, data[at : at + chars]

    end, changes, kinds, chars = block(0, 4)
    rule = ""
    if data[4:5] >= b"2":
        end, changes, kinds, chars = block(end, 8)
        rule = data[end:].decode("ascii", "replace").strip().partition(",")[0]
    last: dict[tuple[str, int], float] = {}
    forever = set(re.findall(r"[A-Za-z]{3,}", rule))
    for k, (_, which) in enumerate(changes or [(0, 0)]):
        offset, _, at = kinds[which]
        name = chars[at : chars.index(0, at)].decode()
        until = changes[k + 1][0] if k + 1 < len(changes) else float("inf")
        last[name, offset] = max(until, last.get((name, offset), until))
    newest = {n: max((t, o) for (m, o), t in last.items() if m == n)[1] for n, _ in last}
    for name in forever & set(newest):  # what the rule for the future names is in use still
        last[name, newest[name]] = float("inf")
    out: dict[str, list[int]] = {}
    for (name, offset), _ in sorted(last.items(), key=lambda x: (-x[1], x[0])):
        if name.isalpha() and name != "LMT":
            out.setdefault(name.upper(), []).append(offset)
    return out


@lru_cache(maxsize=1)
def _zone_tables() -> tuple[list[str], list[str]]:
    """Known zones, and a hash table 'zone abbreviation' -> seconds, from all of the tz database.

    The table has a row for each CRC-32 modulo its length; both are bounded by the tz
    database.
    """
    zones = sorted(z for z in available_timezones() if not z.startswith(("posix", "right", "localtime", "Factory")))
    table: list[list[str]] = [[] for _ in range(1024)]
    for z in zones:
        for name, offsets in zone_names(_zone_file(z)).items():
            key = f"{z} {name}"
            table[zlib.crc32(key.encode()) % len(table)].append(f"{key}={';'.join(map(str, offsets))}")
    return zones, ["|".join(x) for x in table]


def utc_micros(value: Column, zone: Column) -> Column:
    """Microseconds since 1970-01-01 UTC that ``value`` denotes, else null.

    ``zone`` is the IANA name for values written without an offset.
    """
    pattern, layout = instant_pattern()
    laid = F.regexp_replace(value, F.lit(pattern), F.lit(layout))
    # transform over a one-element array binds the parsed parts once for all uses below
    parsed = F.array(F.struct(F.split(laid, r"\|").alias("c"), laid.startswith(_MARK).alias("ok"), zone.alias("zone")))
    return F.get(F.transform(parsed, _assemble), F.lit(0))


def _assemble(row: Column) -> Column:
    parts, ok, zone = row["c"], row["ok"], row["zone"]
    raw = {f: F.get(parts, F.lit(k)) for k, f in enumerate(_FIELDS)}
    raw["y"] = F.regexp_replace(raw["y"], _MARK, "")
    months = F.str_to_map(F.lit(_month_numbers()), F.lit(","), F.lit(":"))
    num = lambda f: raw[f].try_cast("int")
    p, q = num("p"), num("q")
    day_first = p > 12
    month = F.coalesce(num("m"), F.try_element_at(months, F.lower(raw["b"])).try_cast("int"), F.when(day_first, q).when(q > 12, p))
    day = F.coalesce(num("d"), F.when(day_first, p).when(q > 12, q))
    half = F.lower(raw["k"])
    hour24 = F.when(half == "", num("h")).when((num("h") >= 1) & (num("h") <= 12), num("h") % 12 + F.when(half == "p", 12).otherwise(0))
    fraction = F.rpad(F.substring(raw["f"], 1, 6), 6, "0").cast("int")
    civil = F.struct(
        num("y").alias("y"), month.alias("m"), day.alias("d"), hour24.alias("h"), num("i").alias("i"),
        F.coalesce(num("s"), F.lit(0)).alias("s"), F.coalesce(fraction, F.lit(0)).alias("f"),
        F.regexp_replace(F.regexp_replace(raw["o"], "−", "-"), ":", "").alias("o"),
        F.upper(raw["a"]).alias("a"), raw["r"].alias("r"), raw["e"].alias("e"), raw["g"].alias("g"), zone.alias("zone"), ok.alias("ok"),
    )
    return F.get(F.transform(F.array(civil), _resolve), F.lit(0))


def _resolve(c: Column) -> Column:
    zones, abbreviations = _zone_tables()
    y, m, d, h, i, s = (c[x] for x in "ymdhis")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = c["ok"] & (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last) & h.between(0, 23) & i.between(0, 59) & s.between(0, 59)
    yy = y - F.when(m <= 2, 1).otherwise(0)
    idiv = lambda a, b: F.floor(a / F.lit(b)).cast("bigint")
    era = idiv(yy, 400)
    yoe = yy - era * 400
    doy = idiv(153 * (m + F.when(m > 2, -3).otherwise(9)) + 2, 5) + d - 1
    days = era * 146097 + yoe * 365 + idiv(yoe, 4) - idiv(yoe, 100) + doy - 719468
    local = ((days * 86400 + h.cast("bigint") * 3600 + i * 60 + s) * 1_000_000 + c["f"]).cast("bigint")

    off_h = F.substring(c["o"], 2, 2).try_cast("int")
    off_m = F.coalesce(F.when(F.length(c["o"]) > 3, F.substring(c["o"], 4, 2)).try_cast("int"), F.lit(0))
    offset = F.when(
        (off_h <= 18) & (off_m <= 59), (off_h * 60 + off_m) * F.when(c["o"].startswith("-"), -1).otherwise(1)
    )
    name = F.concat_ws(" ", c["zone"], c["a"])
    row = F.get(F.split(F.lit("\n".join(abbreviations)), "\n"), F.pmod(F.crc32(name), F.lit(len(abbreviations))).cast("int"))
    known = F.split(F.try_element_at(F.str_to_map(row, F.lit(r"\|"), F.lit("=")), name), ";")
    # a name that stood for several offsets means the one the zone had then, else the latest
    shown = lambda x: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(local - x.cast("bigint") * 1_000_000), c["zone"]))
    named = F.when(F.size(known) > 1, F.coalesce(F.get(F.filter(known, lambda x: shown(x) == local), F.lit(0)), F.get(known, F.lit(0)))).otherwise(F.get(known, F.lit(0)))
    by_name = F.when(c["a"].isin(ZERO_OFFSET_NAMES), 0).otherwise(named.try_cast("int"))
    seconds = F.when(c["o"] != "", offset * 60).when(c["a"] != "", by_name)
    zone = F.when(c["r"] != "", c["r"]).otherwise(c["zone"])
    utc = F.to_utc_timestamp(F.timestamp_micros(local), zone)
    by_zone = F.when(zone.isin(zones), F.when(F.unix_micros(F.from_utc_timestamp(utc, zone)) == local, F.unix_micros(utc)))
    fixed = (c["o"] != "") | (c["a"] != "")
    civil = F.when(fixed, local - seconds.cast("bigint") * 1_000_000).otherwise(by_zone)

    n = F.length(c["e"])
    digits = c["e"].try_cast("decimal(20,0)")
    part = F.rpad(F.substring(c["g"], 1, 6), 6, "0")
    sub = lambda k: F.coalesce(F.substring(part, 1, k).try_cast("bigint"), F.lit(0)) if k else F.lit(0)
    epoch = (
        F.when(n <= 11, digits.cast("bigint") * 1_000_000 + sub(6))
        .when(n <= 14, digits.cast("bigint") * 1_000 + sub(3))
        .when(n <= 17, digits.cast("bigint"))
        .otherwise(F.floor(digits / 1000).try_cast("bigint"))
    )
    return F.when(c["ok"] & (c["e"] != ""), epoch).when(valid, civil)


def not_exact_utc(value: Column) -> Column:
    """True where the text isn't yet exactly ``YYYY-MM-DDThh:mm:ssZ``."""
    return ~value.rlike(EXACT_UTC)
