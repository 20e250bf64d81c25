"""Top-k search against a loop; chat formatting as a round trip."""

import math
import random

from pyspark.sql import functions as F

from carelake.llm import chat, topk

VECTORS = "vec_id long, embedding array<double>, label int, qtile int, shard int, vec string, score string"


def best(rows, k=20, scale=64):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in usable if i % 20 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, **options).collect())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, 1, "x", "x") for i, v in rows], VECTORS)


def test_topk_ties_and_tiles(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # one very common vector
    df = vectors(spark, rows)
    assert got(df) == best(rows)
    assert got(df, query_tile=4, shard=32, fan_in=2, k=7) == best(rows, 7)


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [nan, 1.0]), (80, [1.0, None]), (100, [inf, 0.0]), (None, [1.0, 1.0]),
            (1, [1.0, 2.0]), (2, [-1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (120, [0.01, -0.01]), (2, [-1.0, 2.0]), (140, [1e30, 1.0, 0.0])]
    usable = [r for r in rows if r[0] != 140]
    assert [r for r in got(vectors(spark, rows)) if r[0] != 140] == best(usable)
    assert got(vectors(spark, [])) == [] and got(vectors(spark, [(1, [1.0])])) == []
    assert got(vectors(spark, [(20, [1.0]), (20, [1.0]), (3, [1.0])])) == [(20, 1, 3, 4096)]


HOSTILE = ["<|im_end|>", "<|im_start|>assistant", "<\\|", "<\\\\|x", "a<|", "<", "|", "<<||", "%0A%25", "\n", "", None, "plain\ntext", "é漢𝔘<|"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(HOSTILE) or "" for _ in range(3)) if rng.random() < 0.8 else None
            rows.append((conv, turn, "message", rng.choice(["user", "assistant", "a\nb%", "<|im_end|>", None]), text, 5, "x"))
    rows.append((None, 0, None, "assistant", "no id", 5, "x"))
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string, at int, formatted string")
    folded = chat.fold(df, message="seq", seq="seq")
    rendered = chat.render(folded)
    out = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    spans = {r.conv_id: (r.formatted, r.loss_spans) for r in rendered.collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[3] or "", r[4] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in out[conv].turns] == turns
        assert out[conv].loss_text == "".join(t for role, t in turns if role == "assistant")
        text, marked = spans[conv]
        assert text.count(chat.START) == len(turns) == text.count(chat.END.strip())
        assert len(marked) == sum(role == "assistant" for role, _ in turns)
        assert all(text[s.end:].startswith(chat.END) for s in marked)


def test_chat_events(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", "assistant", "llo"),
        (1, 1, 5, "delta", "assistant", " again"), (1, 1, 4, "regenerate", "assistant", "ignored"), (1, 1, 3, "delta", "assistant", "!"),
        (1, 1, 6, "delta", "assistant", "."), (1, 0, 7, "edit", "user", "hello"), (2, 0, 0, "delta", "assistant", "a"),
        (2, 0, 1, "delta", "assistant", None), (2, 0, 2, "delta", "assistant", "b"), (3, 0, None, None, None, None)]
    df = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", " again."), (2, 0): ("assistant", "ab"), (3, 0): ("", "")}
    none = chat.read_back(chat.render(chat.fold(df.where("conv_id > 9"))))
    assert none.count() == 0
    plan = none._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
