"""The pipeline's stages against what each must do, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from murmura.llm import byte_bpe, importance, langid, mixing, ngram_join
from murmura.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import rows_of, sql_rows
from tests.conftest import DATA
from tests.llm.test_neighbours import brute

P = pytest.importorskip("public_tokenizers")
SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    got, want = rows_of(QUERIES[name](spark, SF)), sql_rows(duck("sf0.001"), ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_answer_for_whole_tables(spark, name):
    df = QUERIES[name](spark, SF)
    docs, vectors = spark.read.parquet(f"{SF}/documents.parquet").count(), spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    want = {"op9_vantage": vectors * 5}.get(name, docs)
    assert df.count() <= want if name == "op2_importance" else df.count() == want


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stage_by_stage(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = corpus_pipeline.quality_classifier(spark, docs, SF).cache()
    assert good.columns == columns and ids(good) == ids(importance.select(docs, labels)[1])
    known = corpus_pipeline.language_id(spark, good, SF).cache()
    said = langid.predict(good).collect()
    assert known.columns == columns and ids(known) == sorted(r.doc_id for r in said if r.lang_pred != "und" and r.score >= 0.5)
    single = corpus_pipeline.near_duplicates(spark, known, SF).cache()
    want, _ = brute([(r.doc_id, r.text) for r in known.collect()], ngram_join.Rule(5, 80, 100))
    assert single.columns == columns and ids(single) == sorted({c for _, c in want.values()})
    mixed = corpus_pipeline.source_mixing(spark, single, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert mixed.columns == columns and ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    last = corpus_pipeline.byte_level_bpe(spark, mixed, SF)
    assert sorted(map(str, last.collect())) == sorted(map(str, byte_bpe.digests(mixed, ranks, P.PATTERN).collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, last.collect()))


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_stages_take_odd_rows_and_any_columns(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the operators' inner names."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, None, None, None, None), (None, "some words here", "en", None, 3), (900_001, "", "en", "s", 0), (900_002, "long text goes on " * 20_000, "en", "s", 1), (900_003, "\n\t ", None, "s", 1), (900_004, "twice the same", "en", "s", 1), (900_004, "twice the same", "en", "s", 1), (900_004, "other text", "en", "s", 1)]
    inner = {c: F.lit(1) for c in ("_id", "_doc", "_score", "_lang_pred", "_key", "_weight", "_grams", "_c0", "_try", "_bar", "rate", "copies", "n_tokens", "component_id", "_text")}
    docs = plain.union(spark.createDataFrame(odd, plain.schema)).withColumns(inner)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = out.count()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and 0 < rows
            before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
            assert {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} <= before
        else:
            assert rows == docs.count()


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
