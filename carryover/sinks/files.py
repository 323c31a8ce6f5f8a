"""File writing on a driver or a task: safe paths, and replacement in one step."""

from __future__ import annotations

import os
import stat
import tempfile


def safe_join(root: str, relative: str) -> str:
    """``relative`` under ``root``; refuses absolute paths, ``..``, backslashes, NUL and links on the way."""
    if not relative or relative.startswith("/") or "\\" in relative or "\0" in relative or relative[1:2] == ":":
        raise ValueError(f"unsafe path {relative!r}")
    parts = [p for p in relative.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"unsafe path {relative!r}")
    at = os.path.realpath(root)
    for k, p in enumerate(parts):
        at = os.path.join(at, p)
        try:
            mode = os.lstat(at).st_mode
        except FileNotFoundError:
            continue
        if stat.S_ISLNK(mode) or k < len(parts) - 1 and not stat.S_ISDIR(mode):
            raise ValueError(f"a link or file is in the way of {relative!r}")
    return os.path.join(os.path.realpath(root), *parts)


def read_or_none(path: str) -> bytes | None:
    """The bytes of a regular file; None only where nothing is there."""
    try:
        mode = os.lstat(path).st_mode
    except FileNotFoundError:
        return None
    if not stat.S_ISREG(mode):
        raise ValueError(f"{path} is not a regular file")
    with open(path, "rb") as f:
        return f.read()


def replace_file(path: str, data: bytes, expected: bytes | None) -> None:
    """Writes ``data`` if the file still holds ``expected`` (None: if nothing is there), in one step."""
    if read_or_none(path) != expected:
        raise RuntimeError(f"{path} changed since it was read")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".part-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if read_or_none(path) != expected:
            raise RuntimeError(f"{path} changed while it was written")
        if expected is None:
            os.link(temporary, path)  # fails if something has come there
        else:
            os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
