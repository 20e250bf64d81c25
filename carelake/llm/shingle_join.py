"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct ``SHINGLE``-word shingles, lower-cased from A to Z; two
documents link when their sets' Jaccard similarity reaches the threshold. The result is
every document's connected component, found exactly and without listing links:

1. Documents of equal sets are one: the one with the least id stands for them.
2. Every shingle's number of sets is counted over all documents (``blocks``). A set with so
   many shingles of its own that the rest is too little links with nothing and is done.
   That leaves copies with changes and documents made of shared passages.
3. Sets that share a least hash are compared with one pivot each, which joins most copies.
4. The remaining sets are partitioned into groups of similar ones (same most frequent
   shingle, same large component), at most about ``GROUP`` each, and every group stores the
   union of its members' shingles. Shingles in ascending order of frequency, a set's first
   ``n - ceil(threshold * n) + 1`` must contain one shared with any partner, so the matrix
   needs only those; groups that share one of them, but for those wholly in one component,
   are a candidate pair.
5. A pair is opened for the sets whose overlap with the other group's union reaches what the
   threshold asks; their exact overlaps are one matrix product.

Every filter is an upper bound on the overlap, so no link between components is lost. Equal
hashes count as equal shingles (64 bits).

Steps that move texts or sets go over them in slices, one job each, and pairs of groups are
opened in as many slices as keep what a job moves small beside the texts; what was staged
for a step goes when the step is done. So the number of links changes the time, not the disk.

Defined results: with fewer than ``SHINGLE`` words the whole sequence is the one shingle;
null, empty and blank texts have no set and link with nothing; rows without an id link with
nothing and have no component; rows that share an id are one vertex; repeated rows have
equal results; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm import blocks
from carelake.llm.common import by_slice, lookup_hot, numbered, staged, staged_slices, unstaged
from carelake.llm.components import components
from carelake.llm.words import mix, window_hashes, word_hashes

SHINGLE = 5
PERCENT = 75
GROUP = 128
ROUNDS = 3
PREFIX_ROWS = 1_000_000
#: Bytes of text for each of at most ``SLICES`` slices, and of sets that a job moves at least.
SLICE_BYTES = 256 << 20
SLICES = 4
#: ``tokens`` are the shingles that other sets have too, in ascending order of frequency; the
#: first ``lead`` of them must contain one shared with any partner.
_SETS = ("doc_id long, n long, tokens binary, lead long, common double, family long, "
         + ", ".join(f"key{r} long" for r in range(ROUNDS)))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, offsets = word_hashes(texts, lower=True)
    runs, out = window_hashes(words, size), []
    for a, b in zip(offsets, offsets[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        else:  # the number of words keeps short sequences apart from shingles
            out.append(mix(window_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> bytes:
    """Equal for equal sets, and otherwise different but for a chance of 2**-128."""
    return (len(tokens).to_bytes(8, "little") + int(tokens.sum(dtype=np.uint64)).to_bytes(8, "little")
            + int(mix(tokens + np.uint64(1)).sum(dtype=np.uint64)).to_bytes(8, "little"))


def _texts(batch, step: int = 256) -> Iterator[tuple[int, list[np.ndarray]]]:
    texts = batch.column("text").to_pylist()
    for at in range(0, len(texts), step):
        yield at, shingle_sets(texts[at:at + step])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, sets in _texts(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s) for s in sets], pa.binary())], ["doc_id", "n", "sig"])


def _chosen(docs: pa.Table, reps: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    """(id, set) of the block's documents that stand for their set, each once, by id."""
    wanted = set(zip(reps["doc_id"].to_pylist(), reps["sig"].to_pylist(), strict=True))
    docs = blocks.in_order(docs.filter(pa.compute.is_in(docs["doc_id"], reps["doc_id"].combine_chunks())))
    ids, sets = [], []
    for doc, tokens in zip(docs["doc_id"].to_pylist(), shingle_sets(docs["text"].to_pylist()), strict=True):
        key = (doc, signature(tokens))
        if key in wanted:
            wanted.discard(key)
            ids.append(doc)
            sets.append(tokens)
    return ids, sets


def _short(tokens: np.ndarray, bits: int) -> np.ndarray:
    return tokens >> np.uint64(32 - bits)


def _send(bits: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        _, sets = _chosen(docs, notes)
        found, counts = np.unique(_short(np.concatenate([np.zeros(0, np.uint64), *sets]), bits), return_counts=True)
        return blocks.pack(key[0].as_py(), found, counts, bits, width=4)
    return run


def allowed_misses(n: int, percent: int) -> int:
    """How many of a set's n members any partner may lack."""
    return n - -(-percent * n // 100)


def _survivors(bits: int, percent: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, notes: pa.Table) -> pa.Table:
        is_rep = np.array(notes["sig"].is_valid())
        ids, sets = _chosen(docs, notes.filter(pa.array(is_rep)))
        found = np.unique(_short(np.concatenate([np.zeros(0, np.uint64), *sets]), bits))
        classes = blocks.classes_of(notes.filter(pa.array(~is_rep)), 0, len(found))
        rows = []
        for doc, tokens in zip(ids, sets, strict=True):
            level = classes[np.searchsorted(found, _short(tokens, bits))]
            misses = allowed_misses(len(tokens), percent)
            own = int((level == 0).sum())
            if own > misses:
                continue
            shared = tokens[np.lexsort((tokens, level))[own:]]
            top = int(tokens[level == level.max()][0])
            keys = [int(mix(shared ^ np.uint64(7919 * (r + 1))).min()) for r in range(ROUNDS)]
            rows.append((doc, len(tokens), shared.tobytes(), misses + 1 - own, float(level.mean()),
                         *(x - (x >> 63 << 64) for x in (top, *keys))))
        columns = list(zip(*rows, strict=True)) or [()] * (6 + ROUNDS)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), *[pa.int64()] * (1 + ROUNDS)]
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(_SETS.split(", "), columns, kinds, strict=True)})
    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _pivot_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            columns = (batch.column(c).to_pylist() for c in ("tokens", "pivot_tokens", "n", "pivot_n"))
            for x, y, n, m in zip(*columns, strict=True):
                both = overlap(np.sort(np.frombuffer(x, np.uint64)), np.sort(np.frombuffer(y, np.uint64)))
                linked.append(100 * both >= percent * (n + m - both))
            table = pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            yield from table.to_batches()
    return run


def star_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets and the pivot of those that share a least hash with them.
    The pivot is the set whose shingles are most frequent."""
    keyed = sets.select("doc_id", "common", F.explode(F.array(*[
        F.struct(F.lit(r).alias("round"), F.col(f"key{r}").alias("key")) for r in range(ROUNDS)])).alias("k")
    ).select("doc_id", "common", F.xxhash64("k.round", "k.key").alias("key"))
    pivots = keyed.groupBy("key").agg(F.max_by("doc_id", F.struct("common", -F.col("doc_id"))).alias("b"),
                                      F.count(F.lit(1)).alias("size")).where("size > 1")
    pairs = (lookup_hot(keyed, pivots, "key", "size", keyed.count(), F.xxhash64("doc_id"))
             .where("b IS NOT NULL AND b != doc_id").select(F.col("doc_id").alias("a"), "b").distinct())
    pairs = staged(pairs, "pivot-pairs")
    wanted = pairs.select("b").distinct()
    of_pivots = staged_slices((part.select(F.col("doc_id").alias("b"), F.col("n").alias("pivot_n"), F.col("tokens").alias("pivot_tokens"))
                               .join(wanted, "b", "left_semi") for part in by_slice(sets)), "pivot-sets")
    found = staged_slices((pairs.join(part.select(F.col("doc_id").alias("a"), "n", "tokens"), "a").join(of_pivots.drop("slice"), "b")
                           .select("a", "b", "n", "tokens", "pivot_n", "pivot_tokens")
                           .mapInArrow(_pivot_links(percent), "a long, b long") for part in by_slice(sets)), "star-links")
    unstaged(pairs, of_pivots)
    return found.drop("slice")


def in_groups(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, component, grp) of every id of ``sets``: groups of similar sets, about GROUP at
    most. A large component has groups of its own, so pairs of them need no look."""
    sized = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    known = labels.join(sized, "component").select(F.col("vertex").alias("doc_id"), "component", "members")
    ids = sets.groupBy("doc_id").agg(F.min("family").alias("family"))
    joined = (ids.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
              .withColumn("own", F.when(F.col("members") >= GROUP // 4, F.col("component"))))
    kinds = joined.groupBy("family", "own").agg(F.count(F.lit(1)).alias("kind_size"))
    kinds = kinds.select(F.xxhash64("family", "own", F.col("own").isNull()).alias("kind"), "kind_size")
    joined = joined.withColumn("kind", F.xxhash64("family", "own", F.col("own").isNull()))
    out = lookup_hot(joined, kinds, "kind", "kind_size", max(1, ids.count()), F.xxhash64("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("kind_size") / (GROUP * 3 // 4)))
    return out.select("doc_id", "component", F.xxhash64("kind", part).alias("grp"))


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, grp, component) of the shingles that lead a set's order."""
    for batch in batches:
        prefixes = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
        sizes = [len(x) for x in prefixes]
        repeat = lambda c: np.repeat(batch.column(c).to_numpy(), sizes)
        yield pa.RecordBatch.from_pydict({
            "token": pa.array(np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64)),
            "grp": pa.array(repeat("grp"), pa.int64()), "component": pa.array(repeat("component"), pa.int64())})


def _group_pairs(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Pairs of groups that share a shingle in more than one component, each once."""
    rows = rows.sort_by([("token", "ascending"), ("grp", "ascending")])
    token, group = rows["token"].to_numpy(), rows["grp"].to_numpy()
    low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
    cuts = np.concatenate(([0], np.nonzero(token[1:] != token[:-1])[0] + 1, [len(token)]))
    pairs, fresh = set(), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if low[a:b].min() == high[a:b].max():
            continue
        for i in range(a, b):
            apart = (low[i] != high[i]) | (low[i:b] != high[i:b]) | (low[i] != low[i:b])
            apart[0] = low[i] != high[i]
            fresh += [(group[i], g) for g in group[i:b][apart]]
        if len(fresh) > 1 << 20:
            pairs.update(fresh)
            fresh = []
    pairs.update(fresh)
    left, right = zip(*sorted(pairs), strict=True) if pairs else ((), ())
    return pa.table({"left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64())})


def _bundle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A group as one row: its members, by id, with their sets, sorted, one after the other."""
    rows = rows.sort_by("doc_id")
    sets = [np.sort(np.frombuffer(x, np.uint64)) for x in rows["tokens"].to_pylist()]
    return pa.table({
        "grp": pa.array([key[0].as_py()], pa.int64()),
        "docs": pa.array([rows["doc_id"].to_numpy().tobytes()], pa.binary()),
        "comps": pa.array([rows["component"].to_numpy().tobytes()], pa.binary()),
        "sizes": pa.array([rows["n"].to_numpy().tobytes()], pa.binary()),
        "held": pa.array([np.array([len(x) for x in sets], np.int64).tobytes()], pa.binary()),
        "sets": pa.array([b"".join(x.tobytes() for x in sets)], pa.binary())})


class _Group:
    def __init__(self, row: dict, side: str):
        self.docs, self.comps, self.sizes, held = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("docs", "comps", "sizes", "held"))
        tokens = np.frombuffer(row[f"{side}_sets"], np.uint64)
        self.sets = np.split(tokens, np.cumsum(held)[:-1])
        self.union = np.unique(tokens)

    def qualifying(self, other: _Group, percent: int) -> np.ndarray:
        """Members whose overlap with the other group's union may be enough."""
        held = np.array([overlap(s, other.union) for s in self.sets])
        return np.nonzero(100 * held >= percent * self.sizes)[0]


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of membership matrices by slices of shingles."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(common), 4096):
        part = common[at:at + 4096]
        members = []
        for side in (left, right):
            m = np.zeros((len(side), len(part)), np.float32)
            for i, s in enumerate(side):
                s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
                where = np.searchsorted(part, s)
                m[i, where[part[where] == s]] = 1
            members.append(m)
        out += members[0] @ members[1].T
    return out


def _open(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = _Group(row, "left"), _Group(row, "right")
                i, j = left.qualifying(right, percent), right.qualifying(left, percent)
                if not len(i) or not len(j):
                    continue
                both = _overlaps([left.sets[k] for k in i], [right.sets[k] for k in j])
                either = left.sizes[i][:, None] + right.sizes[j][None, :] - both
                linked = (100 * both >= percent * either) & (left.comps[i][:, None] != right.comps[j][None, :])
                a, b = np.nonzero(linked)
                # components that are linked more than once need one row
                rows = sorted({(int(x), int(y)) for x, y in zip(left.comps[i][a], right.comps[j][b], strict=True)})
                if rows:
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array([x for x, _ in rows], pa.int64()), "b": pa.array([y for _, y in rows], pa.int64())})
    return run


def open_groups(sets: DataFrame, members: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): components with a link between them; ``members`` are ``in_groups``'. About
    ``most`` bytes of sets are moved at a time. The files of ``sets`` go."""
    rows = sets.select("doc_id", F.expr("substring(tokens, 1, 8 * cast(lead as int))").alias("prefix")).join(members, "doc_id").mapInArrow(_matrix, "token long, grp long, component long")
    matrix = staged(rows.groupBy("token", "grp").agg(F.min("component").alias("low"), F.max("component").alias("high")),
                    "group-matrix")
    n = max(1, -(-matrix.count() // PREFIX_ROWS))
    pairs = staged(matrix.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(n))).groupBy("bucket")
                   .applyInArrow(_group_pairs, "left long, right long").distinct(), "group-pairs")
    unstaged(matrix)
    # sets of groups that are in no pair stay where they are
    wanted = pairs.select(F.explode(F.array("left", "right")).alias("grp")).distinct()
    wanted = staged(members.join(wanted, "grp", "left_semi"), "paired-members")
    paired = staged_slices((part.select("doc_id", "n", "tokens").join(wanted, "doc_id") for part in by_slice(sets, last_use=True)), "paired-sets")
    slice_of = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n))
    n = 1 + paired.agg(F.coalesce(F.max("slice"), F.lit(0))).first()[0]
    bundles = staged_slices((paired.drop("slice").where(slice_of("grp", n) == i).groupBy("grp").applyInArrow(
        _bundle, "grp long, docs binary, comps binary, sizes binary, held binary, sets binary") for i in range(n)), "groups")
    unstaged(wanted, paired)
    side = lambda s: bundles.select(F.col("grp").alias(s), *[
        F.col(c).alias(f"{s}_{c}") for c in ("docs", "comps", "sizes", "held", "sets")])
    moved = pairs.join(bundles.select(F.col("grp").alias("left"), F.octet_length("sets").alias("size")), "left")
    n = max(1, -(-(moved.agg(F.sum("size")).first()[0] or 0) // most))
    links = staged_slices((pairs.where(slice_of("left", n) == i).join(side("left").where(slice_of("left", n) == i), "left")
                           .join(side("right"), "right").mapInArrow(_open(percent), "a long, b long")
                           for i in range(n)), "group-links")
    unstaged(pairs, bundles)
    return links.drop("slice")


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``df``: the least id that links
    of at least ``percent`` reach."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = staged(docs.mapInArrow(_mark, "doc_id long, n long, sig binary"), "shingle-marks")
    total = max(1, marks.count())
    reps = staged(marks.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig")
                  .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "shingle-reps")
    dealt = blocks.in_blocks(docs, "doc_id", "text", by_text=False)
    notes = (reps.select(F.col("rep").alias("doc_id"), "sig")
             .withColumn("block", blocks.block_of(dealt.n_blocks, "doc_id")))
    bits, n = dealt.bucket_bits, min(SLICES, -(-dealt.n_blocks * blocks.BLOCK_BYTES // SLICE_BYTES))
    part = lambda df, i: df.where(F.col("block") % n == i).groupBy("block")
    keys = staged_slices((part(dealt.docs, i).cogroup(part(notes, i)).applyInArrow(_send(bits), blocks.PACKED)
                          for i in range(n)), "shingle-keys")
    answers = staged_slices((keys.drop("slice").where(F.col("bucket") % n == i).groupBy("bucket")
                             .applyInArrow(blocks.answer(0, width=4), blocks.ANSWER) for i in range(n)), "shingle-answers")
    unstaged(keys)
    told = answers.drop("slice").unionByName(notes, allowMissingColumns=True)
    sets = staged_slices((part(dealt.docs, i).cogroup(part(told, i)).applyInArrow(_survivors(bits, percent), _SETS)
                          for i in range(n)), "shingle-sets")
    unstaged(answers)
    stars = staged(components(star_links(sets, percent)), "star-components")
    members = staged(in_groups(sets, stars), "grouped-ids")
    links = open_groups(sets, members, percent, max(SLICE_BYTES, dealt.n_blocks * blocks.BLOCK_BYTES // 8))
    unstaged(sets, stars)
    joined = components(links)
    labels = (members.join(joined.select(F.col("vertex").alias("component"), F.col("component").alias("wider")), "component", "left")
              .select("doc_id", F.coalesce("wider", "component").alias("component_id")))
    by_set = (reps.join(labels.select(F.col("doc_id").alias("rep"), "component_id"), "rep", "left")
              .select("sig", "copies", F.coalesce("component_id", "rep").alias("component_id")))
    out = lookup_hot(marks, by_set, "sig", "copies", total, F.xxhash64("doc_id"))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of every component, that of the least id (null ids last); all
    columns stay, whatever their names. Rows are told apart by a number of their own, so rows
    that share an id or have none are rows like any other; a repeated row is a near copy."""
    names = [f"c{i}" for i in range(len(df.columns))]
    text, name = (F.col(names[df.columns.index(c)]) for c in (text_col, id_col))
    rows = numbered(df, names, "number")
    linked = link_components(rows.select("number", text.alias("text")), "number", "text", percent)
    linked = linked.select(F.col("doc_id").alias("number"), "component_id")
    named = staged(linked.join(rows.select("number", F.struct(name.isNull(), name, "number").alias("rank")), "number"), "near-members")
    groups = named.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"), F.min("rank").alias("first"))
    groups = groups.where("size > 1").select("component_id", "size", F.col("first.number").alias("stays"))
    told = lookup_hot(named.select("number", "component_id"), groups, "component_id", "size", max(1, named.count()), F.xxhash64("number"))
    # written, so that its size is known: few numbers are broadcast and no text is shuffled
    gone = staged(told.where("stays IS NOT NULL AND stays != number").select("number"), "near-gone")
    return rows.join(gone, "number", "left_anti").select(*names).toDF(*df.columns)
