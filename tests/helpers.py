"""Small helpers of the tests."""

from __future__ import annotations

import io
from contextlib import redirect_stdout


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def plan(df, mode: str = "formatted") -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def framed(text: str | bytes) -> bytearray:
    """A listing body: 15 bytes, the text, 5 bytes."""
    data = text.encode() if isinstance(text, str) else text
    return bytearray(b"x" * 15 + data + b"y" * 5)
