"""Lexical retrieval packing: windows of one length, filled with BM25 neighbours.

Texts become token ids once, written to the shared folder with the document frequency of
every id (a table of the vocabulary's size). Then documents that are lexically near come
together from the whole corpus: rows are range-partitioned and sorted by each document's
``LEADING`` ids of the most weight (count times idf, of ids that other documents have too).
Many documents with the same leading ids spread over several tasks, by a hash. Every task
takes its documents in that order in shards: a shard has an inverted index over the ids of its documents, weighted by BM25 with the
frequencies and the mean length of the whole corpus. A seed document opens a window; its
unused neighbours, best score first, fill the rest. The last one is cut to fit, and what
is left of it is the next seed. Documents longer than a window first fill windows of their
own. What does not fill a window at the end of a shard goes on to the next, so only a
task's last window is short, and that one is divided into powers of two.

Neighbours are searched in the shard, not in the whole corpus; what share of the true ones
that finds is in the README. The index is bounded by the shard.

Ids come from the public byte-level vocabulary through ``tiktoken``, six times as fast as
``tokenizers`` and equal on texts of Latin letters, which a test checks; texts with other
characters or very long words go through ``tokenizers`` itself.

Defined results: null text is empty; every document ends with ``END_ID``, so an empty one is
that id alone; null ids are kept; a repeated row is a document of its own; ties in score go
to the earlier document of the shard; an empty table gives no rows; other columns are
ignored. Offsets are gapless from 0 in every sequence."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import ship, shuffle_partitions, staged

WINDOW = 2048
SHARD = 512
COMMON = 16
LEADING = 3
BOUNDARY_ROWS = 20_000
END_ID = 1
K1, B = 1.2, 0.75
_TOKENS = "doc_id long, ids binary, frequencies binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_LATIN = re.compile(r"[^\t\n\r -~ -ɏ]")
LONG_TEXT, LONG_WORD = 2000, 1000


class Encoder:
    """Token ids of texts, as ``tokenizers`` gives them without special tokens added."""

    def __init__(self, json_path: str):
        import tiktoken

        self.path = json_path
        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = _bytes_of_characters()
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)
        self.size = max([*ranks.values(), *special.values()]) + 1

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if _LATIN.search(text) or (len(text) > LONG_TEXT and max(map(len, text.split()), default=0) > LONG_WORD):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())


@lru_cache(maxsize=2)
def encoder_of(json_path: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    return Encoder(json_path)


#: Fixed value: how the vocabulary's tokenizer splits text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its character where that is visible, and the
    others, in order, as the characters from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tokenised(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids, frequencies): little-endian ids with END_ID of every document, and one
    row per task with the ids' document frequencies in that task and no ids."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        kind, seen = _id_type(encoder.size), np.zeros(encoder.size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for text in part.column(1).to_pylist():
                    ids = np.append(encoder(text), END_ID).astype(kind)
                    seen[np.unique(ids)] += 1
                    out.append(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out, pa.binary()), pa.nulls(part.num_rows, pa.binary())],
                    ["doc_id", "ids", "frequencies"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())],
            ["doc_id", "ids", "frequencies"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _TOKENS)


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _total_frequencies(tokens: DataFrame) -> np.ndarray:
    """Of every id; pairs of the tasks' tables are added in tasks, a table reaches the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0).to_pylist():
                part = np.frombuffer(row, np.int64)
                total = part if total is None else total + part
        if total is not None:
            ids = np.nonzero(total)[0]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})

    found = (tokens.where("frequencies IS NOT NULL").select("frequencies").mapInArrow(add, "id long, n long")
             .groupBy("id").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(1 + max(found["id"].to_pylist(), default=0), np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


class _Document:
    __slots__ = ("doc_id", "ids", "start")

    def __init__(self, doc_id, ids, start=0):
        self.doc_id, self.ids, self.start = doc_id, ids, start


class _Packer:
    """Fills one task's windows, shard after shard."""

    def __init__(self, idf: np.ndarray, mean: float, first_id: int):
        self.idf, self.mean, self.sequence = idf, mean, first_id
        self.rows: list[tuple] = []
        self.filled = 0

    def _place(self, doc: _Document, n: int) -> None:
        piece = doc.ids[doc.start:doc.start + n]
        self.rows.append((doc.doc_id, doc.start, n, len(doc.ids), self.sequence, self.filled,
                          piece.astype("<u4").tobytes()))
        doc.start += n
        self.filled += n
        if self.filled == WINDOW:
            self._close()

    def _close(self) -> None:
        self.sequence, self.filled = self.sequence + 1, 0

    def _index(self, docs: list[_Document]) -> None:
        """Postings by id: which documents of the shard hold it, and with what weight."""
        terms, weights, owners = [], [], []
        for k, doc in enumerate(docs):
            term, tf = np.unique(doc.ids[doc.start:], return_counts=True)
            size = len(doc.ids) - doc.start
            terms.append(term)
            owners.append(np.full(len(term), k, np.int32))
            weights.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean)) * self.idf[term])
        self.terms = terms
        every = np.concatenate(terms)
        order = np.argsort(every, kind="stable")
        self.weight, self.owner = np.concatenate(weights)[order], np.concatenate(owners)[order]
        held = np.bincount(every, minlength=len(self.idf))
        self.begin = np.concatenate(([0], np.cumsum(held)))
        # ids that many of the documents hold have a full row of weights instead of postings
        common = np.nonzero(held >= max(COMMON, len(docs) // COMMON))[0]
        self.row = np.full(len(self.idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), len(docs)))
        at = self.row[every[order]]
        self.full[at[at >= 0], self.owner[at >= 0]] = self.weight[at >= 0]

    def _neighbours(self, seed: int, n: int) -> np.ndarray:
        """The shard's documents by BM25 score for the seed's ids, best first."""
        row = self.row[self.terms[seed]]
        rare = self.terms[seed][row < 0].astype(np.int64)
        begin, size = self.begin[rare], self.begin[rare + 1] - self.begin[rare]
        at = np.repeat(begin + size - np.cumsum(size), size) + np.arange(size.sum())
        score = np.bincount(self.owner[at], weights=self.weight[at], minlength=n) + self.full[row[row >= 0]].sum(axis=0)
        return np.argsort(-score, kind="stable")

    def shard(self, docs: list[_Document]) -> list[_Document]:
        """Pack ``docs``; what is too little for a window comes back."""
        for doc in docs:
            while len(doc.ids) - doc.start >= WINDOW:
                self._place(doc, WINDOW)
        docs = [d for d in docs if d.start < len(d.ids)]
        left = sum(len(d.ids) - d.start for d in docs)
        if left < WINDOW:
            return docs
        self._index(docs)
        used, seed, fresh = np.zeros(len(docs), bool), None, 0
        while left >= WINDOW:
            while seed is None or used[seed]:
                seed, fresh = fresh, fresh + 1
            for k in (seed, *self._neighbours(seed, len(docs))):
                if used[k]:
                    continue
                doc = docs[k]
                n = min(len(doc.ids) - doc.start, WINDOW - self.filled)
                left -= n
                self._place(doc, n)
                used[k] = doc.start == len(doc.ids)
                if self.filled == 0:
                    break
            seed = None if used[k] else k
        return [d for k, d in enumerate(docs) if not used[k]]

    def rest(self, docs: list[_Document]) -> None:
        """The task's last documents: sequences of powers of two, without padding."""
        left = sum(len(d.ids) - d.start for d in docs)
        room = 0
        for doc in docs:
            while doc.start < len(doc.ids):
                if room == 0:
                    room = 1 << (left.bit_length() - 1)
                n = min(room, len(doc.ids) - doc.start)
                self._place(doc, n)
                room, left = room - n, left - n
                if room == 0 and self.filled:
                    self._close()

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in _PIECES.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def gathered(documents: DataFrame, idf: np.ndarray, shared: np.ndarray, kind: str, n: int | None = None) -> DataFrame:
    """The (``n``) ``documents`` (doc_id, ids) with lexically near ones next to each other,
    whatever file they came from; ``shared`` says which ids more than one document has."""
    n = documents.count() if n is None else n
    weight = np.where(shared, idf, 0).astype(np.float32)

    def lead(ids: bytes) -> list[int]:
        term, tf = np.unique(np.frombuffer(ids, kind), return_counts=True)
        size = weight[term] * tf
        best = np.argsort(-size, kind="stable")[:LEADING]
        return [int(t) if w > 0 else -1 for t, w in zip(term[best], size[best], strict=True)] + [-1] * (LEADING - len(best))

    names = [f"lead_{k}" for k in range(LEADING)]
    order = [*names, "salt"]
    columns = "doc_id long, ids binary, salt long, " + ", ".join(f"{c} int" for c in names)

    def keyed(docs: DataFrame, edges: list[tuple] | None = None) -> DataFrame:
        """Documents with their keys and, between ``edges``, their part: one Python process a task."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    leads = [lead(x) for x in some.column("ids").to_pylist()]
                    out = [*some.columns, *[pa.array([key[k] for key in leads], pa.int32()) for k in range(LEADING)]]
                    if edges is None:
                        yield pa.RecordBatch.from_arrays(out, [*some.schema.names, *names])
                        continue
                    salts = some.column("salt").to_pylist()
                    part = [bisect_right(edges, (*key, salt)) for key, salt in zip(leads, salts, strict=True)]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(part, pa.int32())], [*some.schema.names, *names, "part"])

        salted = docs.select("doc_id", "ids", F.xxhash64("doc_id", "ids").alias("salt"))
        return salted.mapInArrow(run, columns if edges is None else columns + ", part int")

    parts = shuffle_partitions(documents.sparkSession)
    # where partitions begin is taken from some rows' keys, so that no more than those are computed twice
    sample = documents.sample(min(1.0, BOUNDARY_ROWS / max(1, n)), seed=6)
    seen = keyed(sample).select(*order).sort(*order).toArrow().to_pylist()
    edges = [tuple(seen[k * len(seen) // parts].values()) for k in range(1, parts)] if seen else []
    dealt = keyed(documents, edges)
    return dealt.repartitionById(parts, "part").sortWithinPartitions(*order, "doc_id").select("doc_id", "ids")


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece;
    ``ids`` are little-endian 32-bit numbers."""
    ship(df.sparkSession)
    tokens = staged(tokenised(df, tokenizer_path, id_col, text_col), "packing-tokens")
    frequency = _total_frequencies(tokens)
    documents = tokens.where("ids IS NOT NULL").select("doc_id", "ids")
    kind = _id_type(encoder_of(tokenizer_path).size)
    width = int(kind[-1])
    n, total = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    mean = max(1.0, total / width / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = _Packer(idf, mean, TaskContext.get().partitionId() << 40), []
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(_Document(doc_id, np.frombuffer(ids, kind)))
                if len(held) >= SHARD:
                    held = packer.shard(held)
                if len(packer.rows) >= 4096:
                    yield packer.taken()
        packer.rest(packer.shard(held))
        if packer.rows:
            yield packer.taken()

    return gathered(documents, idf, frequency > 1, kind, n).mapInArrow(run, _PIECES)
