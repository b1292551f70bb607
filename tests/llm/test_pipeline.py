"""The pipeline stage by stage against plain Python over a small table, and the SQL twins of the registered queries."""

from __future__ import annotations

import os
import re

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from awkward import corpus
from test_text_operators import ASCII_LOWER, groups, simhash_of

import corpus_pipeline
from storeline.llm import queries, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))


def test_stages(spark, tmp_path):
    docs = [(i, t) for i, t in corpus() if i is not None and i not in (79, 80, 88, 89)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(str(tmp_path / "documents.parquet"))
    item = corpus()[82][1]
    spark.createDataFrame([(i, 1, 0) for i, _ in docs[:30]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]

    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(now.collect())
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(seen[0]) == len(docs)  # all labels are 1: nothing to reject
    after_lines = {r["doc_id"]: r["text"] for r in seen[1]}
    assert len(after_lines) == len(docs) and all(r["n_chars"] == len(r["text"] or "") for r in seen[1])
    ids = sorted(after_lines)
    fps = [simhash_of(after_lines[i] or "", 4) for i in ids]
    root = groups(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert sorted(r["doc_id"] for r in seen[2]) == sorted({ids[r] for r in root})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    gone = {tuple(words(item)[p:p + 10]) for p in range(len(words(item)) - 9)}
    clean = {r["doc_id"] for r in seen[2] if not any(tuple(words(r["text"])[p:p + 10]) in gone for p in range(len(words(r["text"]))))}
    assert {r["doc_id"] for r in seen[3]} == clean and 82 not in clean
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in seen[4]:
        assert r["pieces"] == library.encode(after_lines[r["doc_id"]] or "") and r["n_pieces"] == len(r["pieces"]) and r["round_trip"]
    assert {r["doc_id"] for r in seen[4]} == clean


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_", n)[0] for n in names if re.match(r"op\d+_", n)} and "pipeline" in names
    assert os.path.isdir(SF) and set(queries.SQL) <= set(entry.oracle_sql())
