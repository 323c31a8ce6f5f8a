"""Front matter as JSON: the part of YAML that notes use, read without any library.

Maps and lists by indentation, flow lists and maps, plain and quoted scalars, block
scalars (``|`` and ``>``), comments, null, booleans and numbers. What lies outside (anchors,
tags, several documents, repeated keys) is an error, never a guess.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},&*!|>'"%@`-][^#:]*?|[^\s#\[\]{},&*!|>'"%@`][^\s#:]*)\s*:(?:\s+|$)""")
_NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")


class _Lines:
    def __init__(self, text: str) -> None:
        raw = text.replace("\r\n", "\n").split("\n")
        self.raw, self.at = raw, 0

    def peek(self) -> tuple[int, str] | None:
        """(indentation, text) of the next line with content."""
        while self.at < len(self.raw):
            line = self.raw[self.at]
            body = line.strip()
            if body and not body.startswith("#"):
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise ValueError("a tab indents")
                return len(line) - len(line.lstrip(" ")), _uncommented(body)
            self.at += 1
        return None


def _uncommented(body: str) -> str:
    quote = ""
    for k, c in enumerate(body):
        if quote:
            quote = "" if c == quote and body[k - 1] != "\\" else quote
        elif c in "\"'" and (k == 0 or body[k - 1] in " [{,:"):
            quote = c
        elif c == "#" and k and body[k - 1] in " \t":
            return body[:k].rstrip()
    return body


def scalar(text: str) -> object:
    if text[:1] == '"':
        if not re.fullmatch(r'"(?:[^"\\]|\\.)*"', text, re.S):
            raise ValueError("an open quote")
        return json.loads(re.sub(r"\\([^\"\\/bfnrtu])", r"\\\\\1", text).replace("\t", "\\t"))
    if text[:1] == "'":
        if not re.fullmatch(r"'(?:[^']|'')*'", text, re.S):
            raise ValueError("an open quote")
        return text[1:-1].replace("''", "'")
    if text[:1] in "&*!|>%@`":
        raise ValueError("outside the subset")
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if _NUMBER.fullmatch(text):
        return json.loads(text.lstrip("+"))
    return text


def _flow(text: str, at: int, depth: int = 0) -> tuple[object, int]:
    """A flow value at ``at`` and where it ends."""
    if depth > 100:
        raise ValueError("nested too deeply")
    while text[at : at + 1].isspace():
        at += 1
    c = text[at : at + 1]
    if c in ("[", "{"):
        close, out = ("]", []) if c == "[" else ("}", {})
        at += 1
        while True:
            while text[at : at + 1].isspace() or text[at : at + 1] == ",":
                at += 1
            if at >= len(text):
                raise ValueError("an open bracket")
            if text[at] == close:
                return out, at + 1
            value, at = _flow(text, at, depth + 1)
            while text[at : at + 1].isspace():
                at += 1
            if close == "}":
                if text[at : at + 1] != ":":
                    raise ValueError("no value")
                if value in out:
                    raise ValueError("a key is repeated")
                inner, at = _flow(text, at + 1, depth + 1)
                out[str(value)] = inner
            else:
                out.append(value)
    m = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}:]*(?::(?!\s)[^,\[\]{}:]*)*)""").match(text, at)
    return scalar(m[1].strip()), m.end()


def _value(text: str) -> object:
    if text[:1] in ("[", "{"):
        value, end = _flow(text, 0)
        if text[end:].strip():
            raise ValueError("text after a bracket")
        return value
    return scalar(text)


def _block_scalar(lines: _Lines, style: str, indent: int) -> str:
    got: list[str] = []
    inner = None
    while lines.at < len(lines.raw):
        line = lines.raw[lines.at]
        if line.strip():
            here = len(line) - len(line.lstrip(" "))
            if here <= indent:
                break
            inner = here if inner is None else inner
        got.append(line[inner or 0 :])
        lines.at += 1
    while got and not got[-1].strip():
        got.pop()
    body = "\n".join(got) if style[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(got))
    return body if style[1:] == "-" else body + "\n"


def _node(lines: _Lines, indent: int, depth: int) -> object:
    if depth > 100:
        raise ValueError("nested too deeply")
    first = lines.peek()
    if first[1] == "-" or first[1].startswith("- "):
        out: list = []
        while (now := lines.peek()) and now[0] == indent and (now[1] == "-" or now[1].startswith("- ")):
            rest = now[1][1:].strip()
            if rest and (_KEY.match(rest) or rest.startswith("- ")):  # a map or list begins on the line of the dash
                shift = len(lines.raw[lines.at]) - len(lines.raw[lines.at].lstrip(" ")) + len(now[1]) - len(now[1][1:].lstrip())
                lines.raw[lines.at] = " " * shift + rest
                out.append(_node(lines, shift, depth + 1))
                continue
            lines.at += 1
            out.append(_value(rest) if rest else _below(lines, indent, depth))
        return out
    made: dict = {}
    while (now := lines.peek()) and now[0] == indent:
        m = _KEY.match(now[1])
        if not m:
            raise ValueError("no key")
        key, rest = str(scalar(m[1])), now[1][m.end() :].strip()
        if key in made:
            raise ValueError("a key is repeated")
        lines.at += 1
        if rest in ("|", "|-", ">", ">-"):
            made[key] = _block_scalar(lines, rest, indent)
        else:
            made[key] = _value(rest) if rest else _below(lines, indent, depth, lists=True)
    return made


def _below(lines: _Lines, indent: int, depth: int, lists: bool = False) -> object:
    now = lines.peek()
    if now is None or now[0] < indent or now[0] == indent and not (lists and (now[1] == "-" or now[1].startswith("- "))):
        return None
    return _node(lines, now[0], depth + 1)


def parse(text: str) -> dict | None:
    """The map that ``text`` holds, None where there is nothing but comments; else raises ValueError."""
    lines = _Lines(text)
    first = lines.peek()
    if first is None:
        return None
    value = _value(first[1]) if first[1][:1] in ("[", "{") else _node(lines, first[0], 0)
    if first[1][:1] in ("[", "{"):
        lines.at += 1
    if lines.peek() is not None:
        raise ValueError("a line doesn't fit")
    if not isinstance(value, dict):
        raise ValueError("no map")
    return value


@F.pandas_udf(PARSED)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            value = parse(text) if isinstance(text, str) else None
            rows.append((None if value is None else json.dumps(value, ensure_ascii=False), None))
        except (ValueError, RecursionError) as e:
            rows.append((None, str(e)[:80]))
    return pd.DataFrame(rows, columns=["json", "error"], dtype=object)


def front_matter_json(front: Column) -> Column:
    """STRUCT(json, error) of a front matter text; both are null where there is none or only comments."""
    return F.when(front.isNotNull(), _parsed(front)).otherwise(F.lit(None).cast(PARSED))
