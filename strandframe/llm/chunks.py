"""Cutting texts into pieces that the byte-level tokenizer never joins, shared by operators 4 and 9.

The tokenizer starts a new pre-token wherever white space follows something else, so a text may
be cut there: the pieces' ids in a row are the text's ids. ``SPECIAL`` is looked for in the text
first, as the library does by default.
"""

from __future__ import annotations

import re

import pyarrow as pa

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256

# Python's white space includes all that the tokenizer's has.
_AFTER_SPACE = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def pieces(text: str) -> list[str]:
    """The text in pieces; each begins at a blank or line feed that follows no white space."""
    if SPECIAL in text:
        out: list[str] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(SPECIAL)
            out += pieces(part)
        return out
    if "\0" in text or _AFTER_SPACE.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
