"""SentencePiece encoding and decoding with N-best segmentations.

A text's lattice has an edge for every vocabulary piece that occurs in it; a segmentation's
score is the sum of its pieces' scores. Forward Viterbi gives the best score of every
prefix. Those scores are an exact heuristic for a backward A* search from the text's end,
which therefore completes segmentations in order of score and expands little else.

No piece has a space after another character, so the lattice falls apart before every run
of spaces and a text's segmentations are free combinations of its chunks'. Viterbi, forward
and backward, runs on all different chunks of a batch at once and gives each chunk's best
path and, from the best path through an edge off it, how much its second best costs. The N
best of a text then differ from its best in at most the N - 1 chunks where that is least;
A* is run on these, and their lists are merged.

The model is a public ``.model`` file whose path is a parameter; scores are the file's.
Characters without a piece become byte pieces at a score below every piece's. As the model
says, a space is put before a text and spaces are written U+2581.

Defined results: null and empty texts have no pieces, score 0 and no alternatives; texts of
one segmentation have no alternatives; of equal scores the best path has the shorter last
piece of a chunk first, and alternatives come in a fixed order; a text's own U+2581 decodes
as a space; repeated rows get equal results; an empty table gives no rows; other columns
pass through untouched."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from carelake.llm.common import ship
from carelake.llm.words import _powers, mix

SPACE = "▁"
CHUNK_CHARS = 1 << 20
LONG = 48
UNKNOWN_PENALTY = 10.0
BELOW_ALL = -1e8  # pieces scored lower are there for decoding only and do not set the scale
_STEP = 0x9E3779B97F4A7C15
OUT = T.StructType([
    T.StructField("ids", T.BinaryType()), T.StructField("score", T.DoubleType()),
    T.StructField("alternatives", T.ArrayType(T.StructType([
        T.StructField("score", T.DoubleType()),
        T.StructField("edits", T.ArrayType(T.StructType([
            T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()),
            T.StructField("ids", T.ArrayType(T.IntegerType()))])))])))])
_ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct(
    [("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


class Pieces:
    """The pieces of a model, as a dictionary and as hash tables for whole arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_id = {int(self.text[i][1:-1], 16): i for i in range(len(self.text)) if model.is_byte(i)}
        skip = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.entry = {p: (i, model.get_score(i)) for i, p in enumerate(self.text) if not skip(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.entry):
            raise ValueError("pieces with inner spaces are not supported")
        self.unknown = min((s for _, s in self.entry.values() if s > BELOW_ALL), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.entry))
        self.byte_of = np.full(128, -1, np.int32)
        for b, i in self.byte_id.items():
            if b < 128:
                self.byte_of[b] = i
        self._tables()
        self.known = _Known()
        raw = self._raw()
        self.size = np.array([len(r) for r in raw])
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _raw(self) -> list[bytes]:
        """What every piece decodes to."""
        out = [b""] * len(self.text)
        for p, (i, _) in self.entry.items():
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            out[i] = bytes([b])
        return out

    def _tables(self, bits: int = 18) -> None:
        """Pieces by hash. A piece whose slot is taken goes to a further table."""
        left = [(int(_hash_of(p)), i, s) for p, (i, s) in self.entry.items()]
        self.tables, self.bits, self.maybe = [], bits, np.zeros(1 << 21, bool)
        self.maybe[[h >> 43 for h, _, _ in left]] = True
        while left:
            key, pid, score, over = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1), np.zeros(1 << bits), []
            shift = 64 - bits - 7 * len(self.tables)
            for h, i, s in left:
                slot = (h >> shift) & ((1 << bits) - 1)
                if pid[slot] >= 0:
                    over.append((h, i, s))
                else:
                    key[slot], pid[slot], score[slot] = h, i, s
            self.tables.append((np.uint64(shift), key, pid, score))
            left = over

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: none) and score (-inf) of every hash."""
        out, score = np.full(hashed.size, -1, np.int32), np.full(hashed.size, -np.inf)
        at = np.flatnonzero(self.maybe[(hashed >> np.uint64(43)).ravel()])
        sought = hashed.ravel()[at]
        for shift, key, pid, value in self.tables:
            slot = ((sought >> shift) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            hit = (key[slot] == sought) & (pid[slot] >= 0)
            out[at[hit]], score[at[hit]] = pid[slot[hit]], value[slot[hit]]
        return out.reshape(hashed.shape), score.reshape(hashed.shape)

    def edges(self, chunk: str, end: int) -> Iterator[tuple[int, list[int], float]]:
        """(start, ids, score) of the lattice's edges that end at ``end``, short ones first."""
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            found = self.entry.get(chunk[start:end])
            if found:
                yield start, [found[0]], found[1]
            elif start == end - 1:
                yield start, [self.byte_id[b] for b in chunk[start:end].encode()], self.unknown


def _codes(chars: np.ndarray) -> np.ndarray:
    """Characters as random numbers, none of them 0."""
    return mix(chars.astype(np.uint64) + np.uint64(1))


def _hash_of(piece: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in _codes(np.array([ord(c) for c in piece])):
        h = h * np.uint64(_STEP) + c
    return mix(h)[0]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One model per worker process, kept between tasks."""
    return Pieces(path)


def forward(pieces: Pieces, chunk: str) -> list[float]:
    """Best score of every prefix."""
    best = [0.0] + [-np.inf] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start, _, score in pieces.edges(chunk, end):
            best[end] = max(best[end], best[start] + score)
    return best


def n_best(pieces: Pieces, chunk: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best (score, ids): A* from the end, led by the prefixes' best scores. Of equal
    hopes the one nearest the beginning goes first, so ties are not searched in breadth."""
    best = forward(pieces, chunk)
    queue, made, found = [(-best[-1], len(chunk), 0, 0.0, None)], 0, []
    while queue and len(found) < n:
        _, at, _, behind, tail = heapq.heappop(queue)
        if at == 0:
            ids = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            found.append((behind, ids))
            continue
        for start, ids, score in pieces.edges(chunk, at):
            made += 1
            heapq.heappush(queue, (-round(best[start] + score + behind, 6), start, made, score + behind, (ids, tail)))
    return found


def _viterbi(pieces: Pieces, chars: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of chunks of one length (a column each): best score, what the second best costs, the
    ids of the best path at their first characters (-1 elsewhere) and their number, and
    whether that is all there is to say (not with characters beyond ASCII that have no piece)."""
    n, rows = chars.shape
    code, hashed = _codes(chars), np.zeros((n, rows), np.uint64)
    ids, scores = [], []
    for size in range(1, min(n, pieces.longest) + 1):
        hashed = hashed[:n - size + 1] * np.uint64(_STEP) + code[size - 1:]
        found, score = pieces.find(mix(hashed))
        if size == 1:
            lone = found < 0
            found = np.where(lone, pieces.byte_of[np.minimum(chars, 127)], found)
            score = np.where(lone, pieces.unknown, score)
            plain = ~(lone & (chars >= 128)).any(0)
        ids.append(found)
        scores.append(score)
    ahead, back = np.zeros((n + 1, rows)), np.zeros((n + 1, rows), np.int8)
    for end in range(1, n + 1):
        best, step = ahead[end - 1] + scores[0][end - 1], np.ones(rows, np.int8)
        for size in range(2, min(end, len(ids)) + 1):
            total = ahead[end - size] + scores[size - 1][end - size]
            better = total > best
            best, step = np.where(better, total, best), np.where(better, np.int8(size), step)
        ahead[end], back[end] = best, step
    behind = np.full((n + 1, rows), -np.inf)
    behind[n] = 0
    for start in range(n - 1, -1, -1):
        for size in range(1, min(n - start, len(ids)) + 1):
            np.maximum(behind[start], behind[start + size] + scores[size - 1][start], out=behind[start])
    path, count, at, row = np.full((n, rows), -1, np.int32), np.zeros(rows, np.int64), np.full(rows, n), np.arange(rows)
    used = np.zeros((n, rows), np.int8)  # the size of the best path's edge that starts here
    while len(row):
        size = back[at, row].astype(np.int64)
        at = at - size
        used[at, row] = size
        count[row] += 1
        at, row = at[at > 0], row[at > 0]
    for k, found in enumerate(ids):
        of = used[:len(found)] == k + 1
        path[:len(found)][of] = found[of]
    second = np.full(rows, -np.inf)
    for k, score in enumerate(scores):
        through = ahead[:len(score)] + score + behind[k + 1:]
        through[used[:len(score)] == k + 1] = -np.inf
        np.maximum(second, through.max(0), out=second)
    return ahead[n], ahead[n] - second, path, count, plain


class _Known:
    """A direct-mapped memory of segmented chunks, of fixed size, kept by a worker process."""

    BITS, WIDTH = 18, 8

    def __init__(self):
        n = 1 << self.BITS
        self.key, self.count = np.zeros(n, np.uint64), np.zeros(n, np.int8)
        self.score, self.cost, self.ids = np.zeros(n), np.zeros(n), np.zeros((n, self.WIDTH), np.int32)

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        return slot, (self.key[slot] == keys) & (self.count[slot] > 0)

    def learn(self, keys, score, cost, count, begin, flat) -> None:
        fits = np.nonzero((count > 0) & (count <= self.WIDTH))[0]
        slot = (keys[fits] >> np.uint64(64 - self.BITS)).astype(np.int64)
        _, last = np.unique(slot[::-1], return_index=True)  # one chunk to a slot
        fits, slot = fits[::-1][last], slot[::-1][last]
        self.key[slot], self.count[slot], self.score[slot], self.cost[slot] = keys[fits], count[fits], score[fits], cost[fits]
        for k in range(self.WIDTH):
            of = count[fits] > k
            self.ids[slot[of], k] = flat[begin[fits[of]] + k]


class _Batch:
    """The chunks of some texts, each different one segmented once."""

    def __init__(self, pieces: Pieces, texts: list[str]):
        self.pieces = pieces
        self.marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        self.joined = "".join(self.marked)
        chars = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(m) for m in self.marked])
        first = np.cumsum(sizes) - sizes
        space = chars == ord(SPACE)
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[first[sizes > 0]] = True
        self.start = np.nonzero(opens)[0]
        end = np.append(self.start[1:], len(chars))[:len(self.start)]
        power, inverse = _powers(_STEP, len(chars))
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_codes(chars) * power[:len(chars)], out=total[1:])
        key = mix((total[end] - total[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64))
        self.key, self.sample, self.which = np.unique(key, return_index=True, return_inverse=True)
        self.length = (end - self.start)[self.sample]
        self.texts_at = np.searchsorted(self.start, np.append(first, len(chars)))
        self._segment(chars)
        self._lists: dict[int, list[tuple[float, list[int]]]] = {}

    def chunk(self, u: int) -> str:
        at = int(self.start[self.sample[u]])
        return self.joined[at:at + int(self.length[u])]

    def _segment(self, chars: np.ndarray) -> None:
        n = len(self.sample)
        self.score, self.cost, self.count = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
        known = self.pieces.known
        slot, hit = known.slots(self.key)
        had, slot = np.nonzero(hit)[0], slot[hit]
        self.score[had], self.cost[had], self.count[had] = known.score[slot], known.cost[slot], known.count[slot]
        held = np.arange(known.WIDTH) < self.count[had][:, None]
        owners, flat, slow = [np.repeat(had, self.count[had])], [known.ids[slot][held]], []
        new = np.nonzero(~hit)[0]
        for length in np.unique(self.length[new]):
            group = new[self.length[new] == length]
            if length > LONG:
                slow += group.tolist()
                continue
            for at in range(0, len(group), 1 << 13):
                part = group[at:at + (1 << 13)]
                columns = chars[self.start[self.sample[part]] + np.arange(length)[:, None]]
                score, cost, path, count, plain = _viterbi(self.pieces, columns)
                slow += part[~plain].tolist()
                self.score[part], self.cost[part], self.count[part] = score, cost, count
                row, place = np.nonzero((path.T >= 0) & plain[:, None])
                owners.append(part[row])
                flat.append(path[place, row])
        for u in slow:
            found = n_best(self.pieces, self.chunk(u), 2)
            self.score[u], ids = found[0]
            self.cost[u] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            self.count[u] = len(ids)
            owners.append(np.full(len(ids), u))
            flat.append(np.array(ids, np.int64))
        owner = np.concatenate(owners)
        self.flat = np.concatenate(flat)[np.argsort(owner, kind="stable")].astype("<u4")
        self.begin = np.cumsum(self.count) - self.count
        known.learn(self.key[new], self.score[new], self.cost[new], self.count[new], self.begin[new], self.flat)

    def ids(self, chunks: np.ndarray) -> np.ndarray:
        """Best ids of a sequence of chunks."""
        count = self.count[chunks]
        at = np.repeat(self.begin[chunks] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.flat[at]

    def choices(self, u: int, n: int) -> list[tuple[float, list[int]]]:
        """The n best of a chunk as (cost above the best, ids), the best path first."""
        if u not in self._lists:
            best = self.flat[self.begin[u]:self.begin[u] + self.count[u]].tolist()
            others = [(self.score[u] - s, ids) for s, ids in n_best(self.pieces, self.chunk(u), n) if ids != best]
            self._lists[u] = [(0.0, best), *others[:n - 1]]
        return self._lists[u]

    def text(self, k: int, n: int) -> tuple[bytes, float, list[dict]]:
        chunks = self.which[self.texts_at[k]:self.texts_at[k + 1]]
        if not len(chunks):
            return b"", 0.0, []
        ids, best = self.ids(chunks), float(self.score[chunks].sum())
        cost, results = self.cost[chunks], [(0.0, ())]
        for place in np.argsort(cost, kind="stable")[:n - 1].tolist():
            if np.isinf(cost[place]):
                break
            options = self.choices(int(chunks[place]), n)
            results = sorted((total + more, (*picks, (place, j)) if j else picks)
                             for total, picks in results for j, (more, _) in enumerate(options))[:n]
        offset = np.cumsum(self.count[chunks]) - self.count[chunks]
        edits = lambda picks: [{
            "at": int(offset[p]), "drop": int(self.count[chunks[p]]), "ids": self.choices(int(chunks[p]), n)[j][1]}
            for p, j in sorted(picks)]
        return ids.tobytes(), best, [{"score": best - total, "edits": edits(picks)} for total, picks in results if picks]


def apply_edits(ids: np.ndarray, edits: list[dict]) -> np.ndarray:
    """An alternative's ids, from the best ids and its edits."""
    parts, end = [], 0
    for e in edits:
        parts += [ids[end:e["at"]], np.array(e["ids"], ids.dtype)]
        end = e["at"] + e["drop"]
    return np.concatenate([*parts, ids[end:]])


def encode(df: DataFrame, model_path: str, text_col: str = "text", n: int = 4, decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids`` (best, little-endian 32 bit), ``score`` and up to n - 1
    ``alternatives`` in order of score, as edits of the best (replacing columns of those
    names). ``decoded`` names a further column for the text that the ids decode to."""
    ship(df.sparkSession)
    fields = [*OUT.fields, *([T.StructField(decoded, T.StringType())] if decoded else [])]
    names = [f.name for f in fields]
    kept = df.select(*[c for c in df.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for batch in batches:
            column, at = batch.column(text_col), 0
            sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (size == 0 or size < CHUNK_CHARS):
                    size += sizes[end] + 1
                    end += 1
                some = _Batch(pieces, [t or "" for t in column.slice(at, end - at).to_pylist()])
                ids, score, others = zip(*[some.text(k, n) for k in range(end - at)], strict=True)
                new = [pa.array(ids, pa.binary()), pa.array(score, pa.float64()), pa.array(others, _ALTERNATIVES)]
                if decoded:
                    new.append(pa.array([decode_ids(pieces, np.frombuffer(x, "<u4")) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, *new], [*batch.schema.names, *names])
                at = end

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    size = pieces.size[ids]
    at = np.repeat(pieces.begin[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text = pieces.raw[at].tobytes().decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids (null ids: null; replacing a column of that name)."""
    ship(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c != out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for batch in batches:
            texts = [None if x is None else decode_ids(pieces, np.frombuffer(x, "<u4"))
                     for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))
