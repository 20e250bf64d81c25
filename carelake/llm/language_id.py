"""Language identification: the family first, then related languages inside it.

Features are hashed counts of two and three bytes, square-rooted and of length one, over
the whole text. Families are told apart by one-versus-one linear support vector machines,
and so are the languages within the chosen family; votes decide, summed margins break ties.

The machines are fitted on a bounded sample: the ``per_language`` training rows of every
language with the smallest hash of their id (a documented parameter; the sample, a few
kilobytes a row, is what reaches the driver). Prediction covers every row and whole texts.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is all
text if no training row has a language; languages outside ``FAMILIES`` form a family of
their own kind; a single learned language gets score 1; ties go to the name that sorts
first; repeated rows get equal answers; an empty table gives no rows. Label, source and id
are no inputs of a prediction, and other columns pass through ``predict`` untouched."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import ship
from carelake.llm.grams import chunks, codes, has_letter
from carelake.llm.words import mix

DIMS = 4096
#: Language codes by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
_FAMILY = {code: family for family, members in FAMILIES.items() for code in members}


def features(texts: list[str | None]) -> np.ndarray:
    """One row of DIMS per text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for at, end, buffer, owner in chunks(texts, 2):
        total = np.zeros((end - at) * DIMS)
        for begin in range(0, len(buffer), 1 << 20):  # bounds memory for a very long text
            part = buffer[max(0, begin - 2):begin + (1 << 20)]
            for order in (2, 3):
                gram = codes(part, order)
                new = np.arange(len(gram)) + order - 1 >= min(begin, 2)
                text = owner[max(0, begin - 2) + order - 1:][:len(gram)]
                keep = new & (text >= 0)
                slot = (mix(gram[keep] + np.uint64(order << 56)) >> np.uint64(52)).astype(np.int64)
                total += np.bincount(slot + text[keep] * DIMS, minlength=len(total))
        counts = total.reshape(end - at, DIMS)
        out[at:end] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return out


def _machine(x: np.ndarray, y: np.ndarray, strength: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Weights and offset of a linear machine: squared hinge, classes weighted alike,
    by accelerated gradient steps."""
    x = np.column_stack((x, np.ones(len(x), np.float32)))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (2 * 2.0 + strength))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        moved = ahead - step * (strength * ahead - 2 * (weight * y * slack) @ x)
        ahead, w = moved + np.float32(k / (k + 3)) * (moved - w), moved
    return w


class Model:
    """One-versus-one machines among families, and within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = {code: _FAMILY.get(code, "other") for code in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [c for c in self.langs if family[c] == f] for f in self.families}
        names, group = np.array(langs), np.array([family[c] for c in langs])
        self.pairs, weights = [], []
        for where, values in [(group, self.families), *[(names, self.members[f]) for f in self.families]]:
            for a, b in combinations(values, 2):
                rows = (where == a) | (where == b)
                self.pairs.append((a, b))
                weights.append(_machine(x[rows], np.where(where[rows] == a, 1, -1).astype(np.float32)))
        self.weights = np.array(weights, np.float32).reshape(len(weights), DIMS + 1)

    def _decide(self, names: list[str], margins: dict) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the index of the winner among ``names`` and how sure that is."""
        n = len(next(iter(margins.values()))) if margins else 0
        votes, sums, sure = (np.zeros((n, len(names))) for _ in range(3))
        sure += 1
        for i, j in combinations(range(len(names)), 2):
            m = margins[names[i], names[j]]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
            p = 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
        best = np.lexsort((np.broadcast_to(-np.arange(len(names)), votes.shape), sums, votes), axis=1)[:, -1]
        return best, sure[np.arange(n), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        margin = features(texts) @ self.weights[:, :-1].T + self.weights[:, -1]
        margins = {pair: margin[:, k] for k, pair in enumerate(self.pairs)}
        ones = np.ones(len(texts))
        family, sure = (self._decide(self.families, margins) if len(self.families) > 1
                        else (np.zeros(len(texts), int), ones))
        lang, score = np.full(len(texts), "und", object), np.array(sure, float)
        for f, name in enumerate(self.families):
            rows, members = np.nonzero(family == f)[0], self.members[name]
            if len(members) == 1:
                lang[rows] = members[0]
            elif len(rows):
                best, inner = self._decide(members, {p: m[rows] for p, m in margins.items()})
                lang[rows] = np.array(members, object)[best]
                score[rows] *= inner
        for i, text in enumerate(texts):
            if not has_letter(text):
                lang[i], score[i] = "und", 0.0
        return lang.tolist(), np.clip(score, 0, 1)


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", per_language: int = 500) -> Model:
    """Fit on at most ``per_language`` rows of every language among those where ``train``."""
    ship(df.sparkSession)
    rows = df.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                       (F.xxhash64(F.lit("sample"), id_col, text_col).bitwiseAND(F.lit((1 << 31) - 1)) / (1 << 31)).alias("u"))
    # a first cut by hash, so that the ranking sees little more than the sample
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("lang").alias("_lang"), (F.lit(1.5 * per_language + 50) / F.col("n")).alias("share"))
    cut = (rows.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where("u < share")
           .select("lang", "u", "text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).filter(
                pa.array([has_letter(t) for t in batch["text"].to_pylist()], pa.bool_()))
            x = features(table["text"].to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_pydict({
                "lang": table["lang"].combine_chunks(), "u": table["u"].combine_chunks(),
                "x": pa.array([r.tobytes() for r in x], pa.binary())})

    ranked = F.row_number().over(Window.partitionBy("lang").orderBy("u", "x"))
    sample = (cut.mapInArrow(featurise, "lang string, u double, x binary")
              .withColumn("rank", ranked).where(F.col("rank") <= per_language).select("lang", "x").collect())
    x = np.array([np.frombuffer(r["x"], np.float16) for r in sample], np.float32).reshape(len(sample), DIMS)
    return Model(x, [r["lang"] for r in sample])


def predict(df: DataFrame, model: Model, text_col: str = "text",
            out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the two columns named in ``out`` (replacing any of that name)."""
    ship(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c not in out])
    schema = T.StructType([*kept.schema.fields, T.StructField(out[0], T.StringType()),
                           T.StructField(out[1], T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score = shared.value.predict(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    [*part.schema.names, *out])

    return kept.mapInArrow(run, schema)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` without the rows that are ``und``, with the prediction as their language. Where
    no row teaches a language, only texts without a letter go and languages stay as they are."""
    model = fit(df, F.lit(True), id_col, text_col, lang_col)
    if not model.langs:
        return df.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    taken = {c.lower() for c in df.columns}
    found_lang, found_score = (next(n for k in range(len(taken) + 1) if (n := f"_{base}{k}") not in taken) for base in ("lang", "score"))
    found = predict(df, model, text_col, (found_lang, found_score))
    return found.where(F.col(found_lang) != "und").select(*[
        F.col(found_lang).cast(df.schema[lang_col].dataType).alias(lang_col) if c == lang_col else F.col(f"`{c}`") for c in df.columns])
