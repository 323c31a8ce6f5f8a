"""Shapes of the documents that runs exchange: settings, plan reports and receipts.

A document is checked where it is read and where it is written. Errors name the document
and the place, never the value.
"""

from __future__ import annotations

import re

# The keys of each document; a trailing ? marks those that may be missing.
SATELLITE = {"satellite_id": r"[a-z2-7]{8}|[A-Za-z0-9_-]{1,64}", "path": [None, str], "label?": [None, str]}
SETTINGS = {"gate": r"pass|block", "allowlist?": (str,), "satellites?": (SATELLITE,)}
REPORT = {
    "digest": r"sha256:[0-9a-f]{64}", "source": str, "home": str, "targets": ((str,),), "satellite_id": str, "kind": r"export_bundle|directory", "system": str,
    "policy": {"gate": r"pass|block", "allowlist": (str,)}, "summary": ({"target": str, "status": r"accepted|transformed|omitted|unresolved|rejected", "code": [None, str], "n": int},),
    "inventory": ({"status": r"claimed|unclaimed|registered_only", "state": r"data_present|empty", "n": int},), "anomalies": ({"code": str, "n": int},), "gate": {"total": int, "findings": int, "blocked": int, "allowlisted": int},
    "counts": ({"registered": int, "deleted": int},), "unavailable": ({"system": str, "layer": str, "reason": str},),
}
DOCUMENTS = {"settings": SETTINGS, "report": REPORT}


def _fault(value: object, shape: object, at: str) -> str | None:
    """The pointer of the first place that doesn't fit, else None."""
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return at
        names = {k.rstrip("?"): (v, k.endswith("?")) for k, v in shape.items()}
        if extra := sorted(set(value) - set(names)):
            return f"{at}/{extra[0]}"
        for k, (inner, optional) in names.items():
            if k not in value:
                if not optional:
                    return f"{at}/{k}"
            elif (bad := _fault(value[k], inner, f"{at}/{k}")) is not None:
                return bad
        return None
    if isinstance(shape, tuple):
        if not isinstance(value, list):
            return at
        return next((bad for n, v in enumerate(value) if (bad := _fault(v, shape[0], f"{at}/{n}")) is not None), None)
    if isinstance(shape, list):
        return None if any(value is None if s is None else _fault(value, s, at) is None for s in shape) else at
    if isinstance(shape, str):
        return None if isinstance(value, str) and re.fullmatch(shape, value) else at
    return None if isinstance(value, shape) and not (shape is int and isinstance(value, bool)) else at


def validate(kind: str, document: object) -> None:
    """Raises ValueError where the document isn't one of its kind."""
    if (bad := _fault(document, DOCUMENTS[kind], "")) is not None:
        raise ValueError(f"{kind}: {bad or '/'} doesn't fit")
