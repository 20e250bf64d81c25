r"""Personal data: exact base patterns, and further kinds found by weak supervision.

Base kinds are fixed patterns, leftmost and not overlapping within a kind: email, ip (parts
at most 255), card (12 to 19 digits that pass Luhn) and phone (9 to 15 digits); a match
that fails its test is dropped and not tried shorter. Base spans always stay.

The other kinds are learned without labels. Candidates of ``secret`` are runs of 10 or more
letters, digits and ``+/_-`` with a letter and a digit, and what a cue word assigns; those of
``name``, ``address``, ``national_id`` and ``local_phone`` are in ``personal``. None overlaps a
base span. Regex, gazetteer and context labelers vote yes, no or nothing on each;
expectation-maximisation over the counts of vote patterns estimates every labeler's
reliability and each pattern's probability; a logistic classifier over the candidates'
features, trained on those probabilities, decides. Every detector has labelers, reliabilities
and a classifier of its own. Patterns and features are small whole numbers, so what is counted
over all documents and reaches the driver is bounded by their combinations, not by the corpus.

Mixed runs are decided from the corpus alone: without candidates there are none. The
classifiers of ``personal`` start from labelers that are right four times in five and move
from there by what the corpus shows, so that kinds it hardly holds are found too.

Defined results: null text is empty; offsets are code points, end exclusive; spans go by
start, then kind as in ``KINDS``; of secrets that overlap the first, longer one stays; repeated
rows get equal spans; an empty table gives no rows; other columns pass through untouched."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm import personal
from carelake.llm.common import ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "name", "address", "national_id", "local_phone")
_RANK = {kind: i for i, kind in enumerate(KINDS)}

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match always takes whole digit runs
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OF_INTEREST = re.compile("[0-9@]")
_DIGIT = re.compile("[0-9]")
_RUN_CHARS = string.ascii_letters + string.digits + "+/_-"
_RUN = re.compile(r"[A-Za-z0-9+/_-]*")
LEAST_RUN = 10

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, floor = 0, 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            left = floor + len(text[floor:at].rstrip(_LOCAL))
            match = _DOMAIN.match(text, at + 1) if left < at else None
            if match:
                end = match.end()
                yield "email", left, end
        floor = max(end, at + 1)  # no address reaches back over an @ or into the last one
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[Span]:
    if not text or not _OF_INTEREST.search(text):
        return []
    spans = list(_emails(text))
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append(("phone", *m.span()))
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def candidates(text: str | None, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be a secret."""
    if not text:
        return
    floor, busy, k = 0, sorted((s[1], s[2]) for s in taken), 0
    reach = 0
    for m in _DIGIT.finditer(text):
        if m.start() < floor:
            continue
        left = floor + len(text[floor:m.start()].rstrip(_RUN_CHARS))
        end = floor = _RUN.match(text, m.start()).end()
        while k < len(busy) and busy[k][0] < end:
            reach = max(reach, busy[k][1])
            k += 1
        run = text[left:end]
        if reach <= left and len(run) >= LEAST_RUN and any(c.isalpha() for c in run):
            yield left, end


#: Words that announce a secret, words that announce a plain number, and how
#: some public services begin their keys.
SECRET_WORDS = frozenset(("password", "passwd", "pwd", "passphrase", "secret", "token", "key", "apikey", "api_key",
                          "auth", "bearer", "credential", "credentials", "access", "private"))
PLAIN_WORDS = frozenset(("version", "license", "chapter", "section", "page", "volume", "issue", "number", "part", "isbn"))
KEY_STARTS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-")
_LAST_WORD = re.compile(r"([A-Za-z_]+)[\s\"'=:(\[<]*$")
NO, NOTHING, YES = 0, 1, 2
LABELERS = 6


def _switches(run: str) -> int:
    kinds = [c.isdigit() for c in run if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))


def votes_and_features(text: str, start: int, end: int) -> tuple[int, int]:
    """The labelers' votes and the candidate's features, each as one small number."""
    run, before = text[start:end], text[max(0, start - 24):start]
    word = _LAST_WORD.search(before)
    word = word.group(1).lower() if word else ""
    mark = before.rstrip(" \"'")[-1:]
    switches = _switches(run)
    letters = [c for c in run if c.isalpha()]
    is_hex = all(c in "0123456789abcdef" for c in run.lower())
    keyed = run.startswith(KEY_STARTS)
    wordy = re.search("[a-z]{5,}", run) is not None and not is_hex
    votes = (
        YES if keyed else NOTHING,                                                      # regex: known beginnings
        YES if is_hex and len(run) >= 16 else NO if wordy else NOTHING,                 # regex: hexadecimal
        YES if word in SECRET_WORDS else NO if word in PLAIN_WORDS else NOTHING,        # gazetteer
        YES if mark in ("=", ":") else NOTHING if mark.isalnum() else NO,               # context: assigned
        YES if switches >= 5 else NO if switches <= 1 else NOTHING,                     # regex: mixed digits
        YES if len(run) >= 16 and len(set(run)) >= 9 else NO if len(set(run)) < 6 else NOTHING,  # regex: variety
    )
    case = 0 if all(c.islower() for c in letters) else 1 if all(c.isupper() for c in letters) else 2
    features = (
        min(5, (len(run) - LEAST_RUN) // 5), case, min(3, switches // 3), int(is_hex), int(keyed),
        int(mark in ("=", ":")), int(word in SECRET_WORDS), min(3, len(set(run)) // 5))
    code_v = code_f = 0
    for v in votes:
        code_v = 3 * code_v + v
    for f in features:
        code_f = 6 * code_f + f
    return code_v, code_f


def _digits(code: int, base: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        code, d = divmod(code, base)
        out.append(d)
    return out[::-1]


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation with one true answer per candidate. A labeler that says
    nothing says nothing about the answer; where it votes, it is right with a chance of its
    own for either answer, which starts from four right in five votes. Gives those chances
    (labeler, answer), the probability of yes for every vote pattern, and the share of yes.
    ``votes``: (pattern, labeler); ``counts``: of patterns."""
    for_yes, for_no = (votes == YES).astype(float), (votes == NO).astype(float)
    yes = (for_yes.sum(1) + 0.5) / (for_yes.sum(1) + for_no.sum(1) + 1)
    for _ in range(rounds):
        share = ((counts * yes).sum() + 1) / (counts.sum() + 2)
        right = np.column_stack([
            ((weight[:, None] * agrees).sum(0) + 4) / ((weight[:, None] * (for_yes + for_no)).sum(0) + 5)
            for weight, agrees in ((counts * (1 - yes), for_no), (counts * yes, for_yes))])
        log_yes = np.log(share) + for_yes @ np.log(right[:, 1]) + for_no @ np.log(1 - right[:, 1])
        log_no = np.log(1 - share) + for_no @ np.log(right[:, 0]) + for_yes @ np.log(1 - right[:, 0])
        yes = 1 / (1 + np.exp(np.clip(log_no - log_yes, -50, 50)))
    return right, yes, float(share)


#: What a labeler's vote is worth before the corpus is seen (right four times in five), and
#: what a candidate is worth without any.
_PRIOR_VOTE, _PRIOR_BIAS = float(np.log(4)), -1.5


class Classifier:
    """Which candidates of a detector of ``personal`` are of its kind: a logistic classifier
    over one-hot votes and features. Its weights are held by a prior of one candidate's
    strength at the votes' worth."""

    def __init__(self, detector: personal.Detector, patterns: list[tuple[int, int, int]]):
        self.detector = detector
        self.weights = np.zeros(3 * detector.labelers + 6 * detector.features + 1)
        self.weights[0:3 * detector.labelers:3] = -_PRIOR_VOTE
        self.weights[2:3 * detector.labelers:3] = _PRIOR_VOTE
        self.weights[-1] = _PRIOR_BIAS
        if not patterns:
            return
        votes = np.array([_digits(p[0], 3, detector.labelers) for p in patterns])
        counts = np.array([p[2] for p in patterns], float)
        self.right, yes, self.share = reliabilities(votes, counts)
        x = np.array([self._one_hot(v, _digits(p[1], 6, detector.features)) for v, p in zip(votes, patterns, strict=True)])
        prior = w = self.weights

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float(counts @ (np.logaddexp(0, z) - yes * z) + 0.5 * ((w - prior) ** 2).sum())

        for _ in range(50):  # Newton steps, halved until they gain
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            step, now = np.linalg.solve(hess, x.T @ (counts * (yes - p)) - (w - prior)), loss(w)
            while loss(w + step) > now and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def _one_hot(self, votes, features) -> np.ndarray:
        row = np.zeros(len(self.weights))
        row[[3 * i + v for i, v in enumerate(votes)]] = 1
        row[[3 * self.detector.labelers + 6 * i + f for i, f in enumerate(features)]] = 1
        row[-1] = 1
        return row

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        return [(self.detector.kind, a, b) for a, b in personal.found(self.detector, text, taken)
                if self._one_hot(*self.detector.vote(text, a, b)) @ self.weights >= 0]


def _code(digits: tuple[int, ...], base: int) -> int:
    code = 0
    for d in digits:
        code = base * code + d
    return code


def _without_overlaps(spans: list[Span]) -> list[Span]:
    """Of spans that overlap, the first, longer one."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not kept or s[1] >= kept[-1][2]:
            kept.append(s)
    return kept


class Model:
    """Which candidates are personal data: a logistic classifier over one-hot features for
    mixed runs (``patterns``), a ``Classifier`` for each detector of ``personal``."""

    def __init__(self, patterns: list[tuple[int, int, int]], personal_patterns: dict[int, list[tuple[int, int, int]]],
                 lexicon: personal.Lexicon):
        self.weights = None
        self.lexicon = lexicon
        self.classifiers = [Classifier(d, personal_patterns.get(k, [])) for k, d in enumerate(personal.detectors(lexicon))]
        if not patterns:
            return
        votes = np.array([_digits(p[0], 3, LABELERS) for p in patterns])
        counts = np.array([p[2] for p in patterns], float)
        self.right, yes, self.share = reliabilities(votes, counts)
        x = np.array([self._one_hot(p[1]) for p in patterns])
        w, weight = np.zeros(x.shape[1]), counts / counts.sum()
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w = w + np.linalg.solve(hess, x.T @ (weight * (yes - p)) - 1e-3 * w)
        self.weights = w

    @staticmethod
    def _one_hot(code: int) -> np.ndarray:
        row = np.zeros(8 * 6 + 1)
        row[[6 * i + d for i, d in enumerate(_digits(code, 6, 8))]] = 1
        row[-1] = 1
        return row

    def secrets(self, text: str | None, taken: list[Span]) -> list[Span]:
        if self.weights is None or not text or not _DIGIT.search(text):
            return []
        return [("secret", a, b) for a, b in candidates(text, taken)
                if self._one_hot(votes_and_features(text, a, b)[1]) @ self.weights >= 0]

    def __reduce__(self):
        # detectors are closures over patterns; a process makes them anew from the lexicon
        return _model, (self.lexicon, {k: v for k, v in vars(self).items() if k not in ("lexicon", "classifiers")},
                        [c.weights for c in self.classifiers])

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        if not text:
            return base, base
        digit = _DIGIT.search(text) is not None
        more = [s for c in self.classifiers if digit or not c.detector.needs_digit for s in c.spans(text, base)]
        secrets = _without_overlaps(self.secrets(text, base) + [s for s in more if s[0] == "secret"])
        return base, in_order(base + secrets + [s for s in more if s[0] != "secret"])


def _model(lexicon: personal.Lexicon, values: dict, weights: list[np.ndarray]) -> Model:
    model = Model([], {}, lexicon)
    vars(model).update(values)
    for classifier, w in zip(model.classifiers, weights, strict=True):
        classifier.weights = w
    return model


#: The number of the mixed runs' detector beside those of ``personal``.
_RUNS = -1


def fit(df: DataFrame, text_col: str = "text", lexicon: personal.Lexicon | None = None) -> Model:
    """Count vote patterns with features over all texts; estimate and train on the counts."""
    lexicon = lexicon or personal.Lexicon()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = personal.detectors(lexicon)
        for batch in batches:
            seen: list[tuple[int, int, int]] = []
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                base, digit = base_spans(t), _DIGIT.search(t) is not None
                if digit:
                    seen += [(_RUNS, *votes_and_features(t, a, b)) for a, b in candidates(t, base)]
                for k, d in enumerate(made):
                    if digit or not d.needs_digit:
                        for a, b in personal.found(d, t, base):
                            votes, features = d.vote(t, a, b)
                            seen.append((k, _code(votes, 3), _code(features, 6)))
            columns = list(zip(*seen, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["detector", "votes", "features"])

    ship(df.sparkSession)
    keys = ("detector", "votes", "features")
    counted = (df.select(text_col).mapInArrow(run, "detector int, votes int, features int").groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).collect())
    patterns: dict[int, list[tuple[int, int, int]]] = {}
    for r in counted:
        patterns.setdefault(r["detector"], []).append((r["votes"], r["features"], r["n"]))
    return Model(patterns.pop(_RUNS, []), patterns, lexicon)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def detect(df: DataFrame, model: Model, text_col: str = "text",
           out: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """``df`` with base spans and all spans as ``kind:start:end`` texts (replacing columns
    of those names)."""
    ship(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c not in out])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.StringType()) for c in out]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.spans(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([joined(f[k]) for f in found], pa.string()) for k in (0, 1)]],
                [*batch.schema.names, *out])

    return kept.mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; of spans that overlap, the
    first names the kind."""
    parts, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            parts += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def redact(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with all spans of the text replaced; null texts stay null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            new = pa.array([None if t is None else redacted(t, model.spans(t)[1]) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(
                [new if name == text_col else batch.column(name) for name in batch.schema.names], batch.schema.names)

    ship(df.sparkSession)
    return df.mapInArrow(run, df.schema)
