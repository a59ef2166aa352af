"""Helpers shared by the training-data operators."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T

# Separators become spaces, A-Z lower case; digits, letters and every byte of a non-ASCII character stay.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8; none for null."""
    return text.encode().translate(WORD_TABLE).split() if text else []


def chunks(texts: pd.Series, size: int = 1 << 19) -> Iterator[list[str]]:
    """The texts (null: empty) in order, in lists of about ``size`` characters, which bounds the memory of vectorised
    work; a longer text is a list of its own."""
    held, n = [], 0
    for text in texts:
        text = "" if text is None or text != text else text
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def schema(**fields: T.DataType) -> T.StructType:
    """A struct type that needs no session yet, unlike a type given as a string."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
