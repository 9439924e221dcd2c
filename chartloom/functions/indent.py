"""Indented JSON text, for Arrow functions."""

from __future__ import annotations

import re

import pyarrow as pa

# Fixed pattern: strings, punctuation and bare values of JSON text.
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]|[^{}\[\],:"\s]+', re.ASCII)


def indent(text: str) -> str:
    """JSON text over lines, two spaces a level; its tokens are gone through once, from the first to the last."""
    depth, out, opened = 0, [], False
    for token in TOKEN.findall(text):
        if opened and token not in ("}", "]"):
            out.append("\n" + "  " * depth)
        if token in ("{", "["):
            depth += 1
            out.append(token)
            opened = True
            continue
        if token in ("}", "]"):
            depth -= 1
            out.append(token if opened else "\n" + "  " * depth + token)
        elif token == ",":
            out.append(",\n" + "  " * depth)
        else:
            out.append(": " if token == ":" else token)
        opened = False
    if opened:
        out.append("\n" + "  " * depth)
    return "".join(out)


def indented(texts: pa.Array) -> pa.Array:
    return pa.array([None if text is None else indent(text) for text in texts.to_pylist()], pa.string())
