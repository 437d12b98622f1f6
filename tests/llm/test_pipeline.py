"""The pipeline and the registered queries on small tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tallyweave.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    at = tmp_path_factory.mktemp("tables")
    say = lambda n: " ".join(f"t{r.randrange(5000)}" for _ in range(n))
    clean = [say(80) for _ in range(30)]
    texts = [*clean, clean[0] + " extra", clean[1], "too short", None, "same same same " * 40, say(80) + "\n" + "b0 b1 b2 b3 b4 b5 b6 b7 b8 b9", say(80) + " token=abcdefgh1234", clean[3][::-1]]
    rows = [(k, t, ["en", "de", "fr"][k % 3], f"src{k % 4}", len(t or ""), "x") for k, t in enumerate(texts)]
    rows += [rows[5], (None, say(70), None, None, None, None), rows[6][:1] + (say(90), "en", "src2", 9, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, "b0 b1 b2 b3 b4 b5 b6 b7 b8 b9"), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 9 > 0), int(k % 10 == 0)) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_stages(spark, tables):
    at, rows = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at).cache()
        seen[name] = {r.doc_id for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == names
        if name == "secret scans":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert text[36].endswith("[assign]") and "abcdefgh1234" not in text[36]
            lengths = {r.doc_id: (r.n_chars, len(r.text)) for r in docs.where("doc_id = 36").collect()}
            assert lengths[36][0] == lengths[36][1]
    assert seen["quality rules"] >= {*range(32), None} and not seen["quality rules"] & {32, 33, 34}
    assert seen["near-duplicates"] == seen["quality rules"] - {30, 31}
    assert seen["decontamination"] == seen["near-duplicates"] - {35}
    assert seen["secret scans"] == seen["decontamination"]
    assert seen["mixing"] <= seen["secret scans"] and seen["mixing"]
    assert corpus_pipeline.run(spark, at).count() == docs.count()


def test_rows_of_one_id_are_judged_apart(spark, tables):
    """Of a row that is there twice one stays; a different text under the same id stays too; rows without an id all stay."""
    at, rows = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    left = corpus_pipeline.near_dedup(spark, docs, at)
    assert left.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())
    gone = {30, 31}  # near copies of 0 and 1
    want = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows if r[0] not in gone})
    assert got == want


def test_staged_tables_go(spark, tables, tmp_path, monkeypatch):
    from tallyweave.llm import _base

    monkeypatch.setattr(_base, "shared_dir", lambda _: f"file://{tmp_path}")
    corpus_pipeline.run(spark, tables[0]).collect()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left <= {"stage", "facts", "plan", "cuts"}  # the last stage's own, which its result still reads


def test_empty(spark, tables, tmp_path):
    at, _ = tables
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, q in queries.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_queries_give_every_document(spark, tables):
    at, rows = tables
    for name, q in queries.QUERIES.items():
        if name not in ("op1_mixing", "op11_audit", "op12_embeddings"):  # their rows aren't documents, or not all
            assert q(spark, at).count() == len(rows), name
