"""A streaming JSON reader that yields path-value-ordinal triples.

It keeps an explicit stack, so nesting is bounded by memory and not by recursion, and
it accepts exactly RFC 8259: no NaN, no trailing commas, no raw control characters.
A repeated key inside one object keeps its last value, as most readers do.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from itertools import accumulate

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(
    r'(?P<string>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
    r"|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>true|false|null)(?!\w)"
)


@dataclass(slots=True)
class Triple:
    """One node of a document.

    ``path`` is its place with array positions kept as ints, ``value`` the JSON text of
    a scalar (None for containers), ``kind`` its JSON type and ``ordinals`` the
    positions in the repeated ancestors, outermost first.
    """

    path: tuple
    kind: str
    value: str | None
    ordinals: tuple = ()


@dataclass(slots=True)
class _Frame:
    array: bool
    path: tuple
    ordinals: tuple
    next: int = 0
    key: str = ""
    start: int = 0
    #: where the nodes of each member are
    seen: dict = field(default_factory=dict)


def _text(raw: str) -> str:
    # a lone surrogate can't be stored as UTF-8
    return json.loads(raw).encode("utf-8", "replace").decode() if "\\" in raw else raw[1:-1]


def triples(text: str) -> list[Triple]:
    """All nodes of ``text`` in document order; raises ValueError where it isn't JSON."""
    out: list[Triple] = []
    stack: list[_Frame] = []
    replaced: list[tuple[int, int]] = []
    at, end, path, ordinals = _SPACE.match(text).end(), len(text), (), ()
    while True:
        # a value begins at ``at``
        c = text[at : at + 1]
        if c in ("{", "["):
            out.append(Triple(path, "array" if c == "[" else "object", None, ordinals))
            frame = _Frame(c == "[", path, ordinals)
            stack.append(frame)
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("]" if frame.array else "}"):
                at, opened = at + 1, False
                stack.pop()
            else:
                opened = True
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(f"no JSON value at {at}")
            kind = m.lastgroup if m.lastgroup != "word" else ("null" if m[0] == "null" else "boolean")
            out.append(Triple(path, kind, _text(m[0]) if kind == "string" else m[0], ordinals))
            at, opened = m.end(), False
        # after a value: close containers, or go on to the next member
        while not opened:
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != end:
                    raise ValueError(f"text after the value at {at}")
                return _without(out, replaced) if replaced else out
            frame = stack[-1]
            if not frame.array:
                frame.seen[frame.key] = (frame.start, len(out))
            c = text[at : at + 1]
            if c == ",":
                at, opened = _SPACE.match(text, at + 1).end(), True
            elif c == ("]" if frame.array else "}"):
                at += 1
                stack.pop()
            else:
                raise ValueError(f"',' or an end is missing at {at}")
        frame = stack[-1]
        if frame.array:
            path, ordinals = (*frame.path, frame.next), (*frame.ordinals, frame.next)
            frame.next += 1
        else:
            m = _SCALAR.match(text, at)
            if not m or m.lastgroup != "string":
                raise ValueError(f"a key is missing at {at}")
            key = _text(m[0])
            at = _SPACE.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"':' is missing at {at}")
            at = _SPACE.match(text, at + 1).end()
            path, ordinals = (*frame.path, key), frame.ordinals
            if key in frame.seen:
                replaced.append(frame.seen[key])
            frame.key, frame.start = key, len(out)


def _without(nodes: list[Triple], ranges: list[tuple[int, int]]) -> list[Triple]:
    """The nodes outside all ranges, which may nest."""
    depth = [0] * (len(nodes) + 1)
    for a, b in ranges:
        depth[a] += 1
        depth[b] -= 1
    return [t for t, d in zip(nodes, accumulate(depth), strict=False) if not d]


def pointer(path: tuple) -> str:
    """RFC 6901 pointer of a path."""
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)
