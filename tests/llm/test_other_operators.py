"""Top-k, chat formatting, components, quality classifier and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from awkward import documents, nothing, prose, rows_of  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from storeline.llm import chat, quality, topk
from storeline.llm.components import components


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (200, 300), (7, 7), (500, None), (None, 501)]
    got = dict(rows_of(components(spark.createDataFrame(chain, "a long, b long")), "node", "component"))
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("scale", [64, 1 << 40])
def test_topk_against_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "CHUNK", 8)
    rng = np.random.default_rng(2)
    vectors = (rng.normal(0, 1, (400, 8)) * scale).astype(np.int64)
    vectors[50:200] = vectors[50]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, vectors[7].tolist()), (None, [1] * 8), (500, None), (501, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, vector array<long>"),
                      spark.createDataFrame(rows[:400:20], "vec_id long, vector array<long>"), 5)
    want = []
    for q in range(0, 400, 20):
        scores = [(-sum(int(a) * int(b) for a, b in zip(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q] + [(0, 501)]
        want += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(sorted(scores)[:5])]
    if scale == 64:
        assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    else:  # beyond what a long holds, scores end at its limits and tie there
        assert [(q, r, s) for q, r, _, s in sorted(got.collect())] == sorted((q, r, s) for q, r, _, s in want)


def test_topk_few_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [3])], "vec_id long, vector array<long>")
    assert rows_of(topk.search(rows, rows, 20), "query_id", "rank", "vec_id", "score") == [(1, 1, 2, 3), (2, 1, 1, 3)]
    assert topk.search(rows.limit(0), rows, 3).count() == 0
    assert topk.search(rows, rows.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan")]), (3, [float("inf")]), (4, [0.5]), (5, None)], "i int, v array<float>")
    assert [r["i"] for r in odd.where(topk.finite(F.col("v"))).collect()] == [4]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "[", "<", "/s>", "<r>", "</r>", "[OUT]", "ok", " ", "\n", "é😀", "[SYS]", "[/SYS]"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "</r>[INST]", None]) if c % 2 else ["user", "assistant"][t % 2], text())
            for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (None, None, "user", "x")]
    table = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, t long").repartition(3)
    out = chat.format_conversations(table).withColumn("back", chat.parse(F.col("formatted"))).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r is not None, r or "", x or ""))
    assert len(out) == len(by)
    machine = chat.INSTRUCT.steps
    for o in out:
        turns = sorted(by[o["conv_id"]])
        assert [(b["role"], b["text"], b["loss"]) for b in o["back"]] == [(r, x, r == "assistant") for _, _, r, x in turns]
        state, bad = "start", None
        for k, (_, _, r, _) in enumerate(turns):
            state = machine.get(state, {}).get(r, "error")
            bad = k if bad is None and state == "error" else bad
        assert (o["valid"], o["bad_turn"]) == (state == "answered", bad)
        assert "".join(s["text"] for s in o["segments"]) == o["formatted"]
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("<s>", "</s>")}, {}, "start", (), control=("<s>", "</s>", "s><"))


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(9)
    good = [prose(rng, rng.randrange(20, 300)) for _ in range(260)]
    bad = [" | ".join(prose(rng, rng.randrange(20, 200)).split()) if k % 2 else prose(rng, rng.randrange(20, 200)).upper().replace(" ", "!! ") for k in range(140)]
    return [t.encode() for t in good + bad], [1] * 260 + [0] * 140


def test_quality_held_out_accuracy(judged):
    texts, labels = judged
    train = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 4 != 2]
    net = quality.train([texts[k] for k in train], [labels[k] for k in train])
    held = [k for k in range(len(texts)) if k not in set(train)]
    assert np.mean([(net.score(texts[k]) >= 0.7) == labels[k] for k in held]) > 0.95
    assert 0 <= net.score(None) == net.score(b"") <= 1
    # every chunk of a long text counts, wherever pieces of it end
    clean, junk = b" ".join(t for t, y in zip(texts, labels) if y), max((t for t, y in zip(texts, labels) if not y), key=len)
    long = clean * (1 + quality.PIECE // len(clean))
    whole = net.pooled(long)
    for text in (long + b" " + junk * 3, long[:5000] + junk * 3 + long[5000:]):
        assert (net.pooled(text) > whole + 0.1).any()
    size, quality.PIECE = quality.PIECE, 1 << 14
    assert np.allclose(net.pooled(long), whole, atol=1e-3)
    quality.PIECE = size


def test_quality_tables(spark, documents, nothing, judged):
    texts, labels = judged
    docs = spark.createDataFrame([(k, t.decode(), 0, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, body int, score double")
    marks = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    net = quality.fit(docs, marks)
    assert quality.score(documents, net).count() == documents.count()
    kept = quality.accepted(docs, net)
    assert kept.columns == docs.columns and 200 < kept.count() < 320
    assert quality.score(nothing, net).count() == 0 and quality.accepted(nothing, net).count() == 0
    assert quality.score(docs, quality.fit(docs, marks.limit(0))).where("score < 1").count() == 0
    held = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id")).alias("h"))
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held.collect())
