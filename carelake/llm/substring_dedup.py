"""Substring de-duplication by difference-cover anchors.

Every window of ``window`` words whose word sequence starts anywhere else is repeated, and
every word it covers goes. Positions modulo ``period`` in a difference cover are anchors:
for any two positions some shift under ``period`` brings both onto the cover, so two equal
windows share an aligned run of ``window - period + 1`` words that starts on the cover in
both. Only those runs are hashed and counted over all documents (5 of 21 positions at the
default). A window with a repeated anchor is a candidate; the matches are then extended to
whole windows by counting the candidates' own hashes, which decides exactly.

Both counts go through ``blocks``: texts are shuffled once, hashes once each, and answers
come back as a byte per hash. No pairs of documents are formed, so a passage that a third
of all documents share costs one hash per block.

Defined results: null and blank texts have no words; texts under ``window`` words lose
none; a repeated row is another occurrence, so both lose their windows; the input is judged
as it is, not what is left; kept words are joined by one space; an empty table gives no
rows; null ids are kept as they are; other columns are ignored."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carelake.llm import blocks
from carelake.llm.words import inside, window_hashes, word_hashes

#: Perfect difference sets: every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


class _Block:
    """What a block derives from its texts, the same in every pass."""

    def __init__(self, docs: pa.Table, window: int, period: int):
        docs = blocks.in_order(docs)
        self.ids, self.texts = docs["doc_id"], docs["text"].to_pylist()
        self.words, self.offsets = word_hashes(self.texts)
        self.window, self.period = window, period

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors; their distinct hashes, which of them each is, counts."""
        length = self.window - self.period + 1
        hashed = window_hashes(self.words, length)
        in_text = np.arange(len(self.words)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        covered = np.isin(in_text[:len(hashed)] % self.period, COVERS[self.period])
        at = np.nonzero(covered & inside(self.offsets, length, len(hashed)))[0]
        return at, *np.unique(hashed[at], return_inverse=True, return_counts=True)

    def candidates(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Like ``anchors``, for the windows that hold a repeated anchor."""
        at, found, which, _ = self.anchors()
        repeated = at[blocks.classes_of(answers, 0, len(found))[which] > 0]
        hit = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(hit, np.maximum(repeated - self.period + 1, 0), 1)
        np.add.at(hit, repeated + 1, -1)
        hashed = window_hashes(self.words, self.window)
        holds = np.cumsum(hit)[:len(hashed)] > 0
        begin = np.nonzero(holds & inside(self.offsets, self.window, len(hashed)))[0]
        return begin, *np.unique(hashed[begin], return_inverse=True, return_counts=True)

    def kept(self, answers: pa.Table) -> np.ndarray:
        """Which words no repeated window covers."""
        begin, found, which, _ = self.candidates(answers)
        repeated = begin[blocks.classes_of(answers, 1, len(found))[which] > 0]
        cover = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(cover, repeated, 1)
        np.add.at(cover, repeated + self.window, -1)
        return np.cumsum(cover)[:len(self.words)] == 0


def _send_anchors(window: int, period: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        _, found, _, counts = _Block(docs, window, period).anchors()
        return blocks.pack(key[0].as_py(), found, counts, bits)
    return run


def _send_windows(window: int, period: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        _, found, _, counts = _Block(docs, window, period).candidates(answers)
        return blocks.pack(key[0].as_py(), found, counts, bits)
    return run


def _cut(window: int, period: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs, window, period)
        kept, size, removed, texts = block.kept(answers), [], [], []
        for text, a, b in zip(block.texts, block.offsets, block.offsets[1:], strict=False):
            keep = kept[a:b]
            words = (text or "").encode().split()
            size.append(len(words))
            removed.append(len(words) - int(keep.sum()))
            texts.append(b" ".join(words if not removed[-1] else compress(words, keep)).decode())
        return pa.table({"doc_id": block.ids, "n_words": pa.array(size, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})
    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 35, period: int = 21) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per row of ``df``."""
    if period not in COVERS or period > window:
        raise ValueError(f"period must be one of {sorted(COVERS)} and at most the window")
    dealt = blocks.in_blocks(df, id_col, text_col)
    by_block, bits = dealt.docs.groupBy("block"), dealt.bucket_bits
    anchors = by_block.applyInArrow(_send_anchors(window, period, bits), blocks.PACKED)
    first = anchors.groupBy("bucket").applyInArrow(blocks.answer(0), blocks.ANSWER)
    windows = by_block.cogroup(first.groupBy("block")).applyInArrow(
        _send_windows(window, period, bits), blocks.PACKED)
    second = windows.groupBy("bucket").applyInArrow(blocks.answer(1), blocks.ANSWER)
    return by_block.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(
        _cut(window, period), "doc_id long, n_words long, n_removed long, kept_text string")
