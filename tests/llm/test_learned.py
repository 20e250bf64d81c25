"""Language identification, toxicity, personal data, packing and the piece lattice."""

import pickle
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.llm import grams, language_id, packing, personal, pii, piece_lattice, toxicity
from carelake.llm.queries import QUERIES, held_out, tokenizer_path

SF = "/root/testdata/sf0.01"


# --- language identification

def test_language_held_out_accuracy(spark):
    got = QUERIES["op7_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert set(got.columns) == {"doc_id", "held_out", "lang_pred", "score", "lang"}
    right, n, low, high = got.where("held_out").agg(
        F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right / n > 0.98 and 0 <= low <= high <= 1


def test_language_odd_rows(spark, odd, odd_rows, empty):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), ~held_out(3, 1), per_language=60)
    got = language_id.predict(odd, model)
    assert got.count() == len(odd_rows) and got.columns.count("score") == 1
    for r in got.collect():
        assert (r.lang_pred == "und") == (not grams.has_letter(r.text)) and 0 <= r.score <= 1
        assert r.block == 7 or r.doc_id == 22
    assert language_id.predict(empty, model).count() == 0
    assert language_id.fit(empty, F.lit(True)).langs == []
    one = spark.createDataFrame([(1, "only this", "xx"), (2, "x y", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in language_id.predict(one, language_id.fit(one, F.lit(True))).collect()] == [("xx", 1.0)] * 2
    assert {r.doc_id for r in language_id.keep_identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} \
        == {r[0] for r in odd_rows if grams.has_letter(r[1])}


def test_language_features_do_not_depend_on_neighbours():
    texts = ["Une phrase", "x" * 3_000_000, None, "été", ""]
    together = language_id.features(texts)
    for t, row in zip(texts, together):
        assert np.array_equal(language_id.features([t])[0], row)


# --- toxicity

def toxic_rows(rng, n, base=300):
    plain = [f"{a}{b}" for a in ("ta", "mo", "ri", "su", "le", "ko") for b in ("len", "dar", "mis", "tu", "nor", "vik")]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = [rng.choice(plain) for _ in range(rng.randrange(20, base))]
        if toxic:
            for _ in range(max(1, len(text) // 40)):
                text[rng.randrange(len(text))] = "gruff" + rng.choice(plain)
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_toxicity_learns_beginnings(spark):
    rows = toxic_rows(random.Random(9), 700)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (3, 1, None), (10_000, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels, ~held_out(5, 0))
    scored = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(scored[i], t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and sum((s >= 0.5) == bool(t) for s, t in held) / len(held) > 0.97


def test_toxicity_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 22)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert toxicity.score(empty, model).count() == 0
    for seen, want in (((0,), 0), ((1,), 1), ((), 0)):
        some = toxicity.fit(odd, labels.where(F.col("toxic").isin(*seen) if seen else F.lit(False)), F.lit(True))
        assert {round(r.score) for r in toxicity.score(odd, some).collect()} == {want}


def test_toxicity_ratios_are_kneser_ney(spark):
    """The table's log-ratios equal those of a plain loop over the counts."""
    units = {b"ab \0\0": (3, 10), b"abc \0": (0, 20), b"abd \0": (9, 0), b"x \0\0\0": (1, 1)}
    to_int = lambda b: int.from_bytes(b, "big")
    df = spark.createDataFrame([(to_int(u), *n) for u, n in units.items()], "unit long, toxic long, ordinary long")
    got = {r.key: r.ratio for r in toxicity.log_ratios(df).collect()}
    counts = defaultdict(lambda: [0, 0])
    for u, n in units.items():
        word = u.rstrip(b"\0")
        for d in range(1, len(word) + 1):
            counts[word[:d]] = [x + y for x, y in zip(counts[word[:d]], n)]
    root = [sum(n[k] for g, n in counts.items() if len(g) == 1) for k in (0, 1)]
    cut = [toxicity.DISCOUNT * max(1, n / min(root)) for n in root]
    for g, n in counts.items():
        kin = [m for h, m in counts.items() if len(h) == len(g) and h[:-1] == g[:-1]]
        total, p = [sum(m[k] for m in kin) for k in (0, 1)], []
        shared = (sum(n) + 0.05) / (sum(total) + 1)
        for k in (0, 1):
            rest = sum(min(m[k], cut[k]) for m in kin) / total[k] if total[k] else 1
            p.append((max(n[k] - cut[k], 0) / total[k] if total[k] else 0) + rest * shared)
        assert got[(len(g) << 48) | to_int(g)] == pytest.approx(np.log(p[0] / p[1]))


def test_toxicity_learns_word_ends_and_phrases(spark):
    """Words that differ after the fifth byte, in two scripts, and a pair of innocent words."""
    rng, rows, plain = random.Random(21), [], "talen moris sudar lekov tunor".split()
    for harmless, toxic in (("bastion", "bastard"), ("скотина", "скотный"), ("stone river", "stone heart")):
        for i in range(400):
            text = [rng.choice(plain) for _ in range(30)]
            bad = i % 4 == 0
            for word in (toxic if bad else harmless, "brave heart"):
                text[rng.randrange(30)] = word
            rows.append((len(rows), " ".join(text), int(bad), (toxic in " ".join(text))))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, labels, ~held_out(5, 0))).collect()}
    held = [(scored[i], there) for i, _, _, there in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and sum((s >= 0.5) == there for s, there in held) / len(held) > 0.95


def gram_rows(spark, counts):
    """(gram, counts) as ``fit`` has them, all in the first part."""
    rows = [(g, *[n if k == 0 else 0 for n in (ordinary, toxic) for k in range(toxicity.FOLDS)]) for g, (ordinary, toxic) in counts.items()]
    return spark.createDataFrame(rows, "gram string, " + ", ".join(f"{c} long" for c in toxicity._COUNTS))


def test_toxicity_gram_ratios_are_kneser_ney(spark):
    counts = {"abcda": (9, 1), "abcdb": (1, 0), "abcdc": (0, 2), "xbcda": (2, 0), "zzzz ": (0, 1), "zzzzq": (40, 0)}
    got = {r.key: r[f"r{toxicity.FOLDS}"] for r in toxicity.gram_ratios(gram_rows(spark, counts)).collect()}
    cut = [(sum(n[c] == 1 for n in counts.values()) + 0.5)
           / (sum(n[c] == 1 for n in counts.values()) + 2 * sum(n[c] == 2 for n in counts.values()) + 1) for c in (0, 1)]
    assert all(0 < d < 1 for d in cut)
    for gram, n in counts.items():
        kin, p = [m for g, m in counts.items() if g[:-1] == gram[:-1]], []
        total = [sum(m[c] for m in kin) for c in (0, 1)]
        lower = sum(g[1:] == gram[1:] for g in counts) / sum(g[1:-1] == gram[1:-1] for g in counts)
        rest = [sum(min(m[c], cut[c]) for m in kin) / total[c] if total[c] else 1 for c in (0, 1)]
        for c in (0, 1):
            p.append(max(n[c] - cut[c], 0) / max(total[c], 1) + rest[c] * (sum(n) + lower) / (sum(total) + 1))
        assert got[gram] == pytest.approx(np.log(p[1] / p[0]))
        assert got[gram[:-1]] == pytest.approx(np.log(rest[1] / rest[0]))


def test_toxicity_rare_evidence_is_kept(spark):
    """A gram seen in one toxic document and in no ordinary one has mass of its own."""
    counts = {f"ab{a}{b}e": (5, 1 + (a in "cde")) for a in "cdefg" for b in "hijkl"} | {"vwxyz": (0, 1), "vwxya": (4, 0)}
    got = {r.key: r[f"r{toxicity.FOLDS}"] for r in toxicity.gram_ratios(gram_rows(spark, counts)).collect()}
    assert got["vwxyz"] > got["vwxy"] + 0.2 and got["vwxyz"] > got["abche"]


def test_toxicity_table_keeps_every_key():
    keys = np.random.default_rng(4).integers(0, 1 << 63, 3_000_000).astype(np.uint64) * np.uint64(2)
    keys = np.unique(np.concatenate((keys, np.arange(1, 2001, 2, dtype=np.uint64))))  # a thousand share their first bits
    table = toxicity.Table(keys[::-1], np.arange(len(keys), dtype=np.float32)[::-1, None])
    assert np.array_equal(table.ratios[table.places(keys), 0], np.arange(len(keys), dtype=np.float32))
    assert (table.places(np.arange(2001, 4001, 2, dtype=np.uint64)) == -1).all()
    assert (toxicity.Table(keys[:0], np.zeros((0, 1), np.float32)).places(keys[:9]) == -1).all()


# --- personal data

PATTERNS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and pii._luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", "x-y", ".", "+", "1", "255", "256", "00", "4111 1111 1111 1111", "4111111111111111", "é", "漢",
             "(", ")", " ", "-", "+1 (555) 123-4567", "10.0.0.1", "a.b+c@d.e.f", "@@", "٣", "password=21df0bb2a77d9deb8d"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_stay_linear():
    for text in ("1" * 200_000, "a@" * 50_000, "+1 " * 50_000, "1." * 100_000, "a" * 500_000 + "1", "x1 " * 60_000):
        pii.base_spans(text)
        list(pii.candidates(text, []))
    for text in ("Maria " * 60_000, "Aa" * 100_000, "12 Aa " * 40_000, "token=x " * 40_000, "123-45-" * 40_000, "tel 1 " * 40_000,
                 "A" * 300_000, "ssn 1 1" * 30_000, "1 2 " * 60_000):
        start = time.perf_counter()
        for detector in personal.detectors(personal.Lexicon()):
            for a, b in personal.found(detector, text, []):
                detector.vote(text, a, b)
        assert time.perf_counter() - start < 20


def test_pii_finds_secrets(spark, odd, odd_rows, empty):
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(24))
    texts = [f"some words password={key()} and more" for _ in range(60)] + [f"the token: {key()} here" for _ in range(30)]
    texts += [f"see Chapterhouse{i % 7} on the street" for i in range(60)] + ["mail me at a.b@c.example.org 10.1.2.3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(df)
    got = {r.doc_id: r for r in pii.detect(df, model).collect()}
    assert sum("secret:" in got[i].spans for i in range(90)) >= 88
    assert not any("secret:" in got[i].spans for i in range(90, 151))
    clean = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert clean[150] == "mail me at [EMAIL] [IP]" and clean[0] == "some words password=[SECRET] and more"
    assert clean[100] == texts[100]
    assert pii.detect(odd, model).count() == len(odd_rows) and pii.redact(odd, model).count() == len(odd_rows)
    assert pii.detect(empty, pii.fit(empty)).count() == 0
    for r in pii.detect(odd, pii.fit(odd.select("text"))).collect():
        assert r.base_spans == pii.joined(plain_spans(r.text))


def plain_em(rows, rounds=100):
    """Expectation-maximisation over single candidates, one vote after the other."""
    yes = [(sum(v == pii.YES for v in r) + 0.5) / (sum(v != pii.NOTHING for v in r) + 1) for r in rows]
    for _ in range(rounds):
        share = (sum(yes) + 1) / (len(rows) + 2)
        right = []
        for i in range(len(rows[0])):
            chances = []
            for answer, vote in ((0, pii.NO), (1, pii.YES)):
                agrees, voted = 4.0, 5.0
                for r, y in zip(rows, yes, strict=True):
                    if r[i] != pii.NOTHING:
                        weight = y if answer else 1 - y
                        voted += weight
                        agrees += weight * (r[i] == vote)
                chances.append(agrees / voted)
            right.append(chances)
        yes = []
        for r in rows:
            odds = share / (1 - share)
            for i, v in enumerate(r):
                if v == pii.YES:
                    odds *= right[i][1] / (1 - right[i][0])
                if v == pii.NO:
                    odds *= (1 - right[i][1]) / right[i][0]
            yes.append(odds / (1 + odds))
    return right, yes


def test_reliabilities_equal_a_plain_loop():
    rng = random.Random(12)
    rows = []
    for _ in range(300):
        true = rng.random() < 0.3
        rows.append(tuple(pii.NOTHING if rng.random() < 0.3 else pii.YES if (rng.random() < sure) == true else pii.NO
                          for sure in (0.9, 0.8, 0.7, 0.6)))
    kinds = sorted(set(rows))
    right, yes, _ = pii.reliabilities(np.array(kinds), np.array([rows.count(k) for k in kinds], float))
    plain_right, plain_yes = plain_em(rows)
    assert np.allclose(right, plain_right, atol=1e-6)
    of = dict(zip(kinds, yes, strict=True))
    assert np.allclose([of[r] for r in rows], plain_yes, atol=1e-6)


FOUND = {"password: correct-horse-battery": ["secret:correct-horse-battery"], "password: p@ssw0rd!2024": ["secret:p@ssw0rd!2024"],
         "token=abc123": ["secret:abc123"], "SSN 123-45-6789": ["national_id:123-45-6789"],
         "call 555-123-4567": ["local_phone:555-123-4567"],
         "My name is Maria Gonzalez, I live at 12 Elm Street, Springfield": ["name:Maria Gonzalez", "address:12 Elm Street, Springfield"],
         "Anna Weber wohnt in der Hauptstraße 12, Berlin": ["name:Anna Weber", "address:Hauptstraße 12, Berlin"],
         "ask Mr. Okonkwo": ["name:Okonkwo"], "+1 (555) 123-4567": ["phone:+1 (555) 123-4567"],
         "the password is required": [], "Secret: something": [], "see Section 12 Main Road": [], "the secret is well-known": [],
         "version 555-123-4567": [], "near Maria University": [], "The The Retionly Retionly 12 4567": []}


def test_pii_finds_all_kinds_with_a_model_of_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for model in (pii.fit(docs), pii.fit(docs.limit(0)), pickle.loads(pickle.dumps(pii.fit(docs)))):
        for text, want in FOUND.items():
            assert [f"{k}:{text[a:b]}" for k, a, b in model.spans(text)[1]] == want, text
    rows = spark.createDataFrame(list(enumerate(FOUND)), "doc_id long, text string")
    got = {r.text: r.spans for r in pii.detect(rows, model).collect()}
    for text in FOUND:
        assert got[text] == pii.joined(model.spans(text)[1])
        base = [s for s in model.spans(text)[1] if s[0] in pii.BASE]
        assert base == model.spans(text)[0] == plain_spans(text)


def held_out_figures(spark, n=400):
    """Precision and recall per kind on texts of other words and numbers than those fitted on."""
    def make(seed, given, last):
        rng = random.Random(seed)
        number = lambda *sizes: "-".join("".join(rng.choice("23456789") for _ in range(k)) for k in sizes)
        word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
        out = []
        for _ in range(n):
            kind = rng.choice(("secret", "name", "address", "national_id", "local_phone", None))
            value, around = {
                "secret": lambda: (word() + rng.choice("!-_#") + number(3), rng.choice(("password: {}", "pwd={}", "the token = {} here"))),
                "name": lambda: (f"{rng.choice(given)} {rng.choice(last)}", rng.choice(("my name is {}, hello", "we met {} there", "Dear Dr. {},"))),
                "address": lambda: (f"{rng.randrange(1, 999)} {word().title()} {rng.choice(('Street', 'Road', 'Avenue'))}", rng.choice(("lives at {} now", "sent to {} then"))),
                "national_id": lambda: (number(3, 2, 4), rng.choice(("SSN {}", "number {} on file"))),
                "local_phone": lambda: (number(3, 3, 4), rng.choice(("call {} now", "or {} at night"))),
                None: lambda: (rng.choice((word().title(), f"{word().title()} {word().title()}", number(2, 2), f"version {number(3, 3, 4)}", f"page {number(4)}")), "{}"),
            }[kind]()
            text = f"{word()} {word()} {around} {word()}".format(value)
            at = text.index(value)
            out.append((text, [(kind, at, at + len(value))] if kind else []))
        return out

    fitted = make(1, ["John", "Mary", "Linda", "Peter"], ["Smith", "Brown", "Stone"])
    model = pii.fit(spark.createDataFrame([(t,) for t, _ in fitted], "text string"))
    want, got = set(), set()
    for i, (text, spans) in enumerate(make(2, ["Emma", "Pierre", "Ahmed", "Sandra"], ["Okonkwo", "Dupont", "Larsen", "Young"])):
        want |= {(i, *s) for s in spans}
        got |= {(i, *s) for s in model.spans(text)[1]}
    figures = {}
    for kind in pii.KINDS[len(pii.BASE):]:
        w, g = {x for x in want if x[1] == kind}, {x for x in got if x[1] == kind}
        figures[kind] = (len(w & g) / max(1, len(g)), len(w & g) / len(w))
    return figures


def test_pii_kinds_on_held_out_texts(spark):
    for kind, (precision, recall) in held_out_figures(spark).items():
        assert precision >= 0.9 and recall >= 0.9, (kind, precision, recall)


# --- packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def check_pieces(pieces, want):
    """Every id of every document once, sequences gapless and not too long; padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    got = Counter()
    for (doc, _), parts in by_doc.items():
        rows = defaultdict(list)
        for p in parts:
            rows[p.start].append(p)
        copies = max(len(r) for r in rows.values())
        joined = b"".join(p.ids for s in sorted(rows) for p in rows[s][:1])
        if copies == 1:
            assert [s for s in sorted(rows)] == [sum(p.length for r in sorted(rows)[:i] for p in rows[r]) for i in range(len(rows))]
            got[doc, joined] += 1
    assert got == want
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length > 0
            at += p.length
        assert at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0 and total == sum(len(ids) // 4 for _, ids in got.elements())


def test_packing_keeps_every_id(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = Counter((r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
                   for r in docs.collect())
    check_pieces(packing.pack(docs.repartition(3), tokenizer_path("byte_bpe_50k.json")).collect(), want)


def test_packing_odd_rows(spark, odd, odd_rows, empty, tokenizer):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [r for r in odd_rows if r[0] not in (None, 20)]
    want = Counter((r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in rows)
    check_pieces(packing.pack(odd.where("doc_id != 20"), path).collect(), want)
    every = packing.pack(odd, path).collect()
    assert sum(p.length for p in every) == sum(1 + len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows)
    assert packing.pack(empty, path).count() == 0


def test_encoder_equals_tokenizers(tokenizer):
    rng = random.Random(12)
    encoder = packing.encoder_of(tokenizer_path("byte_bpe_50k.json"))
    parts = ["a", " the", "  ", "\n", "\t", "don't", "'ll", "été", "ñandú", "ß", " ", "\u0085", "123", "!!", "<|endoftext|>",
             "漢字", "𝔘", "x" * 40, "\x00", "​", " ", "ǅ", "²", "½"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert encoder(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder("w" * 5000).tolist() == tokenizer.encode("w" * 5000, add_special_tokens=False).ids


def test_neighbours_are_by_bm25():
    idf = np.linspace(0.1, 2, 40).astype(np.float32)
    rng = np.random.default_rng(3)
    docs = [packing._Document(i, rng.integers(0, 40, rng.integers(5, 60)).astype("<u2")) for i in range(30)]
    packer = packing._Packer(idf, 30.0, 0)
    packer._index(docs)
    for seed in range(30):
        query, scores = set(docs[seed].ids.tolist()), []
        for d in docs:
            tf = Counter(d.ids.tolist())
            scores.append(sum(idf[t] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(d.ids) / 30))
                              for t, n in tf.items() if t in query))
        order = packer._neighbours(seed, 30)
        assert np.allclose(np.array(scores)[order], sorted(scores, reverse=True))


def test_neighbours_come_from_the_whole_corpus(spark):
    """Recall of brute-force BM25 neighbours within shards; topics lie far apart in the input."""
    rng, topics, n = np.random.default_rng(5), 50, 2000
    texts = [np.concatenate((rng.integers(0, 60, 40), 100 + 6 * (i % topics) + rng.integers(0, 6, 12))).astype("<u2") for i in range(n)]
    frequency = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=100 + 6 * topics)
    idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    packer = packing._Packer(idf, 52.0, 0)
    packer._index([packing._Document(i, t) for i, t in enumerate(texts)])
    df = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "doc_id long, ids binary")
    rows = packing.gathered(df, idf, frequency > 1, "<u2").withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    count, shard = Counter(), {}
    for r in rows:
        shard[r.doc_id] = r.task, count[r.task] // packing.SHARD
        count[r.task] += 1

    def recall(where):
        near = {i: [k for k in packer._neighbours(i, n)[:11] if k != i][:10] for i in range(0, n, 20)}
        return np.mean([where[i] == where[k] for i, ks in near.items() for k in ks])

    assert recall({i: i // packing.SHARD for i in range(n)}) < 0.35 < 0.7 < recall(shard)


# --- piece lattice

def all_segmentations(pieces, text):
    marked = piece_lattice.SPACE + text.replace(" ", piece_lattice.SPACE)
    paths = [[(0.0, ())]] + [[] for _ in marked]
    for end in range(1, len(marked) + 1):
        for start, ids, score in pieces.edges(marked, end):
            paths[end] += [(total + score, (*path, *ids)) for total, path in paths[start]]
    return sorted(paths[-1], key=lambda p: -p[0])


def test_n_best_equals_brute_force():
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    pieces, model = piece_lattice.pieces_of(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(10)
    parts = ["a", "b", "the", "in", " ", " ", "  ", "\n", "é", "漢", "𝔘", "x", "er", "▁", "\x00"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        ids, score, others = piece_lattice._Batch(pieces, ["zz", text, ""]).text(1, 5)
        best = np.frombuffer(ids, "<u4")
        got = [(score, tuple(best.tolist()))] + [(a["score"], tuple(piece_lattice.apply_edits(best, a["edits"]).tolist())) for a in others]
        every = all_segmentations(pieces, text)
        assert [round(s, 2) for s, _ in got] == [round(s, 2) for s, _ in every[:5]]
        assert len({i for _, i in got}) == len(got) and {i for _, i in got} <= {i for _, i in every}
        for _, i in got:
            assert piece_lattice.decode_ids(pieces, np.array(i)) == text.replace("▁", " ") == model.decode(list(i))


def test_lattice_odd_rows(odd, odd_rows, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    coded = piece_lattice.decode(piece_lattice.encode(odd, path), path)
    got = coded.collect()
    assert len(got) == len(odd_rows) and coded.columns.count("score") == 1
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((r[0], (r[1] or "").replace("▁", " ")) for r in odd_rows)
    for r in got:
        scores = [r.score, *[a.score for a in r.alternatives]]
        assert scores == sorted(scores, reverse=True)
        assert (len(r.ids) == 0) == (not r.text) and (r.text or not r.alternatives)
    assert piece_lattice.encode(empty, path).count() == 0


def test_letters_are_of_the_letter_classes():
    import unicodedata

    from carelake.llm.grams import has_letter
    texts = ["²", "½ ²", "Ⅷ", "①", "12 _ 3", "ª", "é", "漢", "ʰ", "1² x", "", None, "́"]
    assert [has_letter(t) for t in texts] == [any(unicodedata.category(c).startswith("L") for c in t or "") for t in texts]


def test_operators_run_in_a_fresh_application_elsewhere(tmp_path):
    """op6 as the first query, the application started outside the repository."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
sys.path.insert(0, {root!r})
import __spark_entry__ as E
print('rows', E.queries()['op6_packing'](spark, '/root/testdata/sf0.001').count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]
