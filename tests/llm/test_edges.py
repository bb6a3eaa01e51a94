"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import decontam, langid, lm, packing, quality, render, reputation, secretscan, simhash, substrings

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat sat on the mat and looked at the dog " * 4000
ROWS = [
    (1, "the cat sat on the mat", "en", "a", 22),
    (1, "the cat sat on the mat", "en", "a", 22),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "le chat est sur la table", "fr", "b", 24),
    (None, None, None, None, None),
    (4, "12 34 ### \n\t !!", "en", "a", 15),
    (5, LONG, "en", "a", len(LONG)),
    (6, "x" * 300_000, "en", "a", 300_000),
    (7, "\U0001f600 é\u0301 \u0000 \x0b\x0c \ud7ff \u2028 end", "fr", "b", 9),
]
CLASHING = ["id", "fp", "key", "tag", "bucket", "seed", "score", "lang_pred", "word", "n", "item", "doc", "part", "rank"]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(name) for name in CLASHING])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(1, "the cat sat on the mat and looked at the dog the cat sat on the mat"), (2, None), (3, ""), (None, "a b c")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


SMALL_LM = lm.Settings(words=64, others=4, hidden=8, head=16, rounds=1)


def operators(spark, docs, path):
    items = spark.read.parquet(f"{path}/benchmark.parquet")
    return {
        "language": langid.predict(docs, langid.learn(docs)),
        "packing": packing.pack(docs),
        "scores": lm.log_scores(docs.select("doc_id", "text"), docs, SMALL_LM),
        "quality": quality.quality(docs),
        "secrets": secretscan.secret_spans(docs, "doc_id", "source"),
        "html": render.rendered(docs, "doc_id", source="text"),
        "substrings": substrings.without_repeats(docs),
        "simhash": simhash.near_duplicates(docs),
        "contaminated": decontam.contaminated(docs, items),
    }


def test_every_operator_takes_odd_rows(spark, edge, folder):
    for name, frame in operators(spark, clashing(edge), folder).items():
        rows = frame.collect()
        if name not in ("packing", "contaminated"):
            assert len(rows) == len(ROWS), name
    assert {r["doc"] for r in rows} == {5}


def test_every_operator_takes_an_empty_table(spark, none, folder):
    for name, frame in operators(spark, clashing(none), folder).items():
        assert frame.collect() == [], name


def test_an_empty_benchmark_finds_nothing(spark, edge):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(edge, items).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_takes_odd_rows(spark, edge, none, folder, name, stage):
    found = stage(spark, edge, folder).collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert stage(spark, edge, folder).columns == edge.columns
        assert len(found) == {
            # No letters, or nothing: rejected.
            "language_id": 5,
            # The copy, and all but one of those without a word.
            "simhash_near_dedup": 7,
            "benchmark_decontamination": 9,
            "secret_scans": 10,
        }.get(name, len(found)) or name == "language_id"
    else:
        assert sum(r["length"] for r in found) >= len(ROWS)
    assert stage(spark, none, folder).collect() == []


def test_stages_keep_clashing_columns(spark, edge, folder):
    docs = clashing(edge)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        stage(spark, docs, folder).collect()


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.Example.ORG/es/x?y#z"), (2, None), (3, "no scheme"), (4, "x://"), (5, "HTTP://É.com"), (5, "HTTP://É.com"),
         (6, "http://h.com/a://b/c")],
        "page_id long, url string",
    )
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (2, None), (9, 1)], "page_id long, good int")
    found = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in reputation.judged(pages, outcomes).collect()}
    assert {f[:4] for f in found} == {
        (1, "a.example.org", "/es/x", "example.org/es/"), (2, "", "", None), (3, "", "", None), (4, "", "", None),
        (5, "É.com", "", None), (6, "h.com", "/a://b/c", None),
    }
    none = reputation.judged(pages.limit(0), outcomes.limit(0))
    assert none.collect() == []
