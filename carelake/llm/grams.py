"""Byte n-grams of texts: A to Z become lower case, other ASCII that is no letter a blank."""

from __future__ import annotations

import re

import numpy as np

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD_SIGN = re.compile(r"[^\W\d_]")
CHUNK = 1 << 20


def has_letter(text: str | None) -> bool:
    """Whether the text has a character of a Unicode letter class (numerals such as ``²`` or
    ``Ⅷ`` are none)."""
    return bool(text) and any(m.group().isalpha() for m in _WORD_SIGN.finditer(text))


def chunks(texts: list[str | None], pad: int):
    """(first text, its successor, buffer, text of every byte): whole texts of about CHUNK
    bytes together; a longer text comes alone. Every text has ``pad`` blanks on both sides,
    which belong to no text (number -1), so no gram reaches into another one."""
    gap, at = b" " * pad, 0
    while at < len(texts):
        parts, size, end = [], 0, at
        while end < len(texts) and (size == 0 or size < CHUNK):
            parts.append((texts[end] or "").encode().translate(_TABLE))
            size += len(parts[-1])
            end += 1
        owner = np.repeat(
            np.ravel(np.column_stack((np.full(len(parts), -1), np.arange(len(parts))))),
            np.ravel(np.column_stack((np.full(len(parts), pad), [len(p) for p in parts]))))
        yield at, end, np.frombuffer(gap + gap.join(parts) + gap, np.uint8), np.concatenate((owner, np.full(pad, -1)))
        at = end


def codes(buffer: np.ndarray, order: int) -> np.ndarray:
    """The gram of ``order`` bytes (8 at most) that ends at each byte from the order-th on."""
    n = len(buffer) - order + 1
    out = buffer[:n].astype(np.uint64)
    for k in range(1, order):
        out = (out << np.uint64(8)) | buffer[k:k + n]
    return out
