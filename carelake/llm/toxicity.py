"""Toxicity by class-conditional Kneser-Ney models over the characters of whole texts.

Both classes have an interpolated Kneser-Ney model of the next character given the
``ORDER - 1`` before it. Characters are code points, so all scripts have the same depth;
they are in lower case, ASCII that is no letter counts as a blank, and runs of blanks as
one. Every character of a text is scored, a word's end too, and the context goes on over
word borders, so that word ends, inner parts and expressions of several words count.
Counts are in how many documents of the class a gram occurs, not how often, so copies
within a text and long texts do not drown the rest. Discounts are those of the counts of
counts, n1 / (n1 + 2 n2) of each class. What they take from a class goes to a model that
both share: the pooled counts of the grams over the continuation counts of their last
``ORDER - 1`` characters.

A text's figure is its log p(toxic) - log p(ordinary) over its number of characters. The
differences of a word's characters are added, and of their sum counts what exceeds a dead
zone. The dead zone, 0 if it is of no use, and the logistic curve from figure to score are learned inside
the training rows: these are in ``FOLDS`` parts by a hash of the text, every part gets its
figures from the counts of the others, and the zone whose curve has the least log-loss
over all of them is taken. Equal texts are in one part.

Counts are gathered from every labelled training row: tasks count distinct grams, Spark adds
them up by gram and by context. What all tasks need to score with, the log-ratio of every
gram and of every context seen, is a table sized by those keys, with whole 64-bit hashes: no
key is dropped. It grows with the distinct grams of ``ORDER`` characters, and every task's
process holds it. Labels reach the texts by a join; a bounded bit table of labelled ids keeps
unlabelled texts out of its shuffle.

Defined results: null, empty and blank texts have figure 0 and get the score of that figure;
labels with null or other values than 0 and 1 and ids without a label teach nothing; an id
with both labels teaches both; if either class has no rows, all scores are near the other
class's value (0 without labels); if either class has rows in one part only, figures come
from all rows' counts and there is no dead zone; repeated rows teach and score as often as
they are there; an empty table gives no rows. Labels, language, source and id are no inputs
of a score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import ship, staged
from carelake.llm.grams import CHUNK
from carelake.llm.words import mix

ORDER = 5
FOLDS = 3
ZONES = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0)
FLUSH = 3_000_000
_CLASSES = ("ordinary", "toxic")
_COUNTS = [f"{c}_{k}" for c in _CLASSES for k in range(FOLDS)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)
#: Of ``log_ratios`` only.
DEPTH, DISCOUNT = 5, 4.0
_REST = np.uint64(1 << 60)


def _characters(text: str | None) -> np.ndarray:
    """Code points as the model sees them; one blank between words and after the last."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _PLAIN[np.minimum(points, 127)], points)
    blank = points == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    points = points[keep]
    return np.append(points, np.uint32(32)) if len(points) and points[-1] != 32 else points


def windows(texts: list[str | None]):
    """(first text, its successor, characters, place of every gram's end, its text, hash of
    its context, hash of the gram): whole texts of about CHUNK characters together. Before a
    text stand blanks, so no gram reaches into another one."""
    gap, at = np.full(ORDER - 1, 32, np.uint32), 0
    while at < len(texts):
        parts, sizes, end = [], [], at
        while end < len(texts) and sum(sizes) < CHUNK and len(sizes) < 4096:
            part = _characters(texts[end])
            parts += [gap, part]
            sizes.append(len(part))
            end += 1
        points = np.concatenate(parts)
        owner = np.repeat(np.ravel(np.column_stack((np.full(len(sizes), -1), np.arange(len(sizes))))),
                          np.ravel(np.column_stack((np.full(len(sizes), ORDER - 1), sizes))))
        place = np.nonzero(owner >= 0)[0]
        wide = points.astype(np.uint64)
        context = np.zeros(max(0, len(points) - ORDER + 1), np.uint64)
        for k in range(ORDER - 1):
            context = context * _STEP + wide[k:k + len(context)] + np.uint64(1)
        gram = context * _STEP + wide[ORDER - 1:] + np.uint64(1)
        yield at, end, points, place, owner[place], mix(context[place - ORDER + 1]), mix(gram[place - ORDER + 1])
        at = end


def _keys(grams: list[str]) -> np.ndarray:
    """The hashes that ``windows`` gives, from grams or contexts of one length as text."""
    if not grams:
        return np.zeros(0, np.uint64)
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), -1)
    out = np.zeros(len(grams), np.uint64)
    for k in range(points.shape[1]):
        out = out * _STEP + points[:, k].astype(np.uint64) + np.uint64(1)
    return mix(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, counts): in how many documents of each class and part a gram occurs."""
    def flush(held):
        _, first, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        letters = np.concatenate([h[1] for h in held])[first]
        counts = np.concatenate([h[2] for h in held])
        sums = [np.bincount(at, weights=counts[:, k], minlength=len(first)).astype(np.int64) for k in range(len(_COUNTS))]
        for k in range(0, len(first), 200_000):
            mine = slice(k, k + 200_000)
            text = np.ascontiguousarray(letters[mine]).view(f"<U{ORDER}")[:, 0].tolist()
            yield pa.RecordBatch.from_pydict(
                {"gram": pa.array(text, pa.string())} | {c: pa.array(n[mine]) for c, n in zip(_COUNTS, sums, strict=True)})

    held, size = [], 0
    for batch in batches:
        column = (batch.column("toxic").to_numpy(zero_copy_only=False) * FOLDS
                  + batch.column("part").to_numpy(zero_copy_only=False))
        for at, _, points, place, text, _, gram in windows(batch.column("text").to_pylist()):
            if not len(place):
                continue
            once = np.unique(mix(gram + mix(text.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
            keys, first, of = np.unique(gram[once], return_index=True, return_inverse=True)
            counts = np.bincount(of * len(_COUNTS) + column[at + text[once]], minlength=len(keys) * len(_COUNTS))
            letters = points[(place[once][first] - ORDER + 1)[:, None] + np.arange(ORDER)]
            held.append((keys, letters, counts.reshape(-1, len(_COUNTS)).astype(np.int32)))
            size += len(keys)
            if size > FLUSH:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


def log_ratios(units: DataFrame) -> DataFrame:
    """The ratios of the earlier model, of word beginnings alone; ``fit`` does not use them.

    (key, ratio, weight) from (unit, toxic, ordinary): of every beginning seen, and under
    a key with a mark of its own, of anything unseen after a beginning. A key is a
    beginning's bytes and, above 48 bits, their number."""
    steps = [F.when(F.expr(f"(shiftright(unit, {8 * (DEPTH - d)}) & 255) != 0"),
                    F.expr(f"shiftleft({d}L, 48) | shiftright(unit, {8 * (DEPTH - d)})")) for d in range(1, DEPTH + 1)]
    grams = (units.select(F.explode(F.array_compact(F.array(*steps))).alias("key"), "toxic", "ordinary")
             .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
             .withColumn("parent", F.expr("shiftleft(shiftright(key, 48) - 1, 48) | shiftright(key & 281474976710655, 8)")))
    grams = staged(grams, "toxicity-grams")
    size = grams.where(F.shiftright("key", 48) == 1).agg(F.sum("toxic"), F.sum("ordinary")).first()
    least = max(1, min(size))
    cut = {c: DISCOUNT * max(1.0, n / least) for c, n in zip(("toxic", "ordinary"), size, strict=True)}
    above = grams.groupBy("parent").agg(*[
        x for c, d in cut.items() for x in (F.sum(c).alias(f"{c}_all"), F.sum(F.least(F.col(c), F.lit(d))).alias(f"{c}_left"))])
    backoff = {c: F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_left") / F.col(f"{c}_all")).otherwise(1.0) for c in cut}
    shared = (F.col("toxic") + F.col("ordinary") + 0.05) / (F.col("toxic_all") + F.col("ordinary_all") + 1)
    chance = {c: F.coalesce(F.greatest(F.col(c) - d, F.lit(0.0)) / F.nullif(F.col(f"{c}_all"), F.lit(0)), F.lit(0.0))
              + backoff[c] * shared for c, d in cut.items()}
    log = lambda x: F.ln(F.greatest(x["toxic"], F.lit(1e-12))) - F.ln(F.greatest(x["ordinary"], F.lit(1e-12)))
    seen = grams.join(above, "parent").select(
        "key", log(chance).alias("ratio"), (F.col("toxic") + F.col("ordinary")).alias("weight"))
    unseen = above.select(F.expr(f"parent | {int(_REST)}L").alias("key"), log(backoff).alias("ratio"),
                          (F.col("toxic_all") + F.col("ordinary_all")).alias("weight"))
    return seen.unionByName(unseen)


def discounts(grams: DataFrame) -> list[dict[str, float]]:
    """Of every class, without each part and from all rows: n1 / (n1 + 2 n2), where n1 and n2
    grams were seen in one and in two documents."""
    sums = {(c, k): _without(c, k) for k in range(FOLDS + 1) for c in _CLASSES}
    seen = grams.agg(*[F.count_if(x == n).alias(f"{c}_{k}_{n}") for (c, k), x in sums.items() for n in (1, 2)]).first()
    return [{c: (seen[f"{c}_{k}_1"] + 0.5) / (seen[f"{c}_{k}_1"] + 2 * seen[f"{c}_{k}_2"] + 1) for c in _CLASSES}
            for k in range(FOLDS + 1)]


def _without(kind: str, part: int) -> Column:
    """A class's count from all parts but one (from all for ``FOLDS``)."""
    return sum((F.col(f"{kind}_{k}") for k in range(FOLDS) if k != part), F.lit(0))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(key, r0, r1, ...) from (gram, counts): log-ratio of every gram, and of anything unseen
    after a context, without each part's counts and (last) from all."""
    before, names = ORDER - 1, [f"r{k}" for k in range(FOLDS + 1)]
    cut = discounts(grams)
    endings = grams.groupBy(F.expr(f"substring(gram, 2, {before})").alias("ending")).agg(F.count(F.lit(1)).alias("kinds"))
    stems = endings.groupBy(F.expr(f"substring(ending, 1, {before - 1})").alias("stem")).agg(F.sum("kinds").alias("stem_kinds"))
    lower = (endings.withColumn("stem", F.expr(f"substring(ending, 1, {before - 1})")).join(stems, "stem")
             .select("ending", (F.col("kinds") / F.col("stem_kinds")).alias("lower")))
    counted = grams.withColumn("context", F.expr(f"substring(gram, 1, {before})")).withColumn("both", sum(F.col(c) for c in _COUNTS))
    sums = [F.sum("both").alias("both_all"), F.count(F.lit(1)).alias("both_kinds")]
    for k, d in enumerate(cut):
        for c in _CLASSES:
            sums += [F.sum(_without(c, k)).alias(f"{c}_{k}_all"), F.sum(F.least(_without(c, k), F.lit(d[c]))).alias(f"{c}_{k}_left")]
    above = counted.groupBy("context").agg(*sums)
    backoff = lambda c, k: F.when(F.col(f"{c}_{k}_all") > 0, F.col(f"{c}_{k}_left") / F.col(f"{c}_{k}_all")).otherwise(1.0)

    rows = (counted.withColumn("ending", F.expr(f"substring(gram, 2, {before})")).join(lower, "ending").join(above, "context"))

    def chance(c: str, k: int) -> Column:
        # the shared model has the same rows as the classes' own counts
        n, total = (sum((_without(x, k) for x in _CLASSES), F.lit(0)), sum(F.col(f"{x}_{k}_all") for x in _CLASSES))
        shared = (n + F.col("lower")) / (total + 1)
        own = F.greatest(_without(c, k) - cut[k][c], F.lit(0.0)) / F.greatest(F.col(f"{c}_{k}_all"), F.lit(1))
        return own + backoff(c, k) * shared

    seen = rows.select(F.col("gram").alias("key"), *[
        (F.ln(chance("toxic", k)) - F.ln(chance("ordinary", k))).alias(r) for k, r in enumerate(names)])
    unseen = above.select(F.col("context").alias("key"), *[
        (F.ln(backoff("toxic", k)) - F.ln(backoff("ordinary", k))).alias(r) for k, r in enumerate(names)])
    return seen.unionByName(unseen)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("key").to_pylist()
        key = np.zeros(len(text), np.uint64)
        size = np.array([len(t) for t in text], np.int64)
        for n in (ORDER, ORDER - 1):
            key[size == n] = _keys([t for t in text if len(t) == n])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), *[batch.column(k + 1).cast(pa.float32()) for k in range(FOLDS + 1)]],
            batch.schema.names)


class Table:
    """Log-ratios by key: all keys in order, and where each run of equal first bits begins."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratios = keys[order], ratios[order]
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        first = self.keys >> np.uint64(64 - self.bits)
        self.begin = np.searchsorted(first, np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Row of every key, -1 without one."""
        run = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[run], self.begin[run + 1]
        out, left = np.full(len(keys), -1, np.int64), np.nonzero(at < end)[0]
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == keys[left]
            out[left[hit]] = at[hit]
            go = ~hit & (at + 1 < end)
            left, at, end = left[go], at[go] + 1, end[go]
        return out


class Model:
    """The table of log-ratios, the dead zone, and the curve from figure to score."""

    def __init__(self, table: Table | None, slope: float = 0.0, offset: float = 0.0, zone: float = 0.0):
        self.table, self.slope, self.offset, self.zone = table, slope, offset, zone

    def figures(self, texts: list[str | None], parts: np.ndarray | None = None, zones: tuple[float, ...] = ()) -> np.ndarray:
        """Mean log-ratio of every text over its characters, for each dead zone (the model's
        own by default); without the counts of the part that ``parts`` names."""
        zones = zones or (self.zone,)
        out = np.zeros((len(texts), len(zones)))
        if self.table is None:
            return out
        for at, end, points, place, text, context, gram in windows(texts):
            which = parts[at + text] if parts is not None else -1
            found = self.table.places(gram)
            unseen = np.nonzero(found < 0)[0]
            found[unseen] = self.table.places(context[unseen])
            value = np.where(found >= 0, self.table.ratios[np.maximum(found, 0), which], np.float32(0))
            last = points[place] == 32
            word = np.cumsum(last) - last
            of = text[last]
            value = np.bincount(word, weights=value, minlength=len(of))
            size, count = np.abs(value), np.maximum(np.bincount(text, minlength=end - at), 1)
            for k, zone in enumerate(zones):
                beyond = np.sign(value) * np.maximum(size - zone, 0)
                out[at:end, k] = np.bincount(of, weights=beyond, minlength=end - at) / count
        return out

    def scores(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * figures + self.offset, -500, 500)))


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (figure, ordinary, toxic) bins, every
    row weighing alike; Newton steps with a little shrinkage."""
    x, n0, n1 = (np.array(c, float) for c in zip(*bins, strict=True))
    w0, w1 = n0 / (n0.sum() + n1.sum()), n1 / (n0.sum() + n1.sum())
    scale = max(np.sqrt(np.average(x ** 2, weights=w0 + w1)), 1e-9)
    design, beta = np.column_stack((x / scale, np.ones_like(x))), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w1 * (1 - p) - w0 * p) - 1e-4 * beta
        hess = (design * ((w0 + w1) * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        beta = beta + np.linalg.solve(hess, grad)
    return float(beta[0] / scale), float(beta[1])


def _loss(bins: list[tuple[float, int, int]], slope: float, offset: float) -> float:
    x, n0, n1 = (np.array(c, float) for c in zip(*bins, strict=True))
    z = np.clip(slope * x + offset, -500, 500)
    return float((n0 * np.logaddexp(0, z) + n1 * np.logaddexp(0, -z)).sum())


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled rows; docs: (id, text), labels: (id, toxic).
    Of the texts little more than the labelled ones are shuffled."""
    bits = 1 << 24
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = (labels.select(place("id").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")))
    near = (docs.withColumn("_bit", place("id"))
            .join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("word"))
            .where("(mask & shiftleft(1L, cast(_bit & 63 as int))) != 0").select("id", "text"))
    return near.join(labels, "id").select("text", "toxic")


def fit(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """Learn from the rows of ``df`` where ``train`` that ``labels`` marks 0 or 1."""
    spark = df.sparkSession
    docs = df.where(F.coalesce(train, F.lit(False))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = (labels.where(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull())
             .select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("toxic")).distinct())
    taught = staged(_labelled(docs.where("id IS NOT NULL"), marks), "toxicity-train").withColumn(
        "part", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    rows = taught.groupBy("toxic", "part").agg(F.count(F.lit(1)).alias("n")).collect()
    if len({r["toxic"] for r in rows}) < 2:
        return Model(None, 0.0, 40.0 if any(r["toxic"] for r in rows) else -40.0)
    apart = all(len({r["part"] for r in rows if r["toxic"] == c}) > 1 for c in (0, 1))
    zones = ZONES if apart else (0.0,)
    grams = staged(taught.mapInArrow(_count, "gram string, " + ", ".join(f"{c} long" for c in _COUNTS))
                   .groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "toxicity-grams")
    names = [f"r{k}" for k in range(FOLDS + 1)]
    found = gram_ratios(grams).mapInArrow(_hashed, "key long, " + ", ".join(f"{r} float" for r in names)).toArrow()
    keys = found["key"].to_numpy().astype(np.int64).view(np.uint64)
    ratios = np.column_stack([found[r].to_numpy().astype(np.float32) for r in names])
    del found
    model = Model(Table(keys, ratios))
    shared = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False) if apart else None
            figure = shared.value.figures(batch.column("text").to_pylist(), part, zones)
            for k in range(len(zones)):
                yield pa.RecordBatch.from_pydict({
                    "zone": pa.array(np.full(len(figure), k, np.int32)),
                    "bin": pa.array(np.clip(np.round(figure[:, k] * 10_000), -80_000, 80_000).astype(np.int32)),
                    "toxic": batch.column("toxic")})

    tally = (taught.mapInArrow(bins, "zone int, bin int, toxic int").groupBy("zone", "bin")
             .agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).collect())
    shared.destroy()
    best = None
    for k, zone in enumerate(zones):
        of = [(r["bin"] / 10_000, r["n0"], r["n1"]) for r in tally if r["zone"] == k]
        slope, offset = _curve(of)
        if best is None or _loss(of, slope, offset) < best[0]:
            best = _loss(of, slope, offset), slope, offset, zone
    _, model.slope, model.offset, model.zone = best
    model.table.ratios = np.ascontiguousarray(model.table.ratios[:, FOLDS:])
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the column ``out`` (replacing any of that name)."""
    ship(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c != out])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figure = shared.value.figures(batch.column(text_col).to_pylist())[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(figure), pa.float64())],
                                             [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
