"""Queries of this folder against their SQL; the pipeline against its stages."""

import zlib
from pathlib import Path

import duckdb
import pytest
from test_simhash import firsts

import corpus_pipeline
from lintlake.llm import decontam, langid, secretscan
from lintlake.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(map(repr, cursor.fetchall()))
    frame = QUERIES[name](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in names)) for r in frame.collect()) == theirs


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage was given and what it returned."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, rows, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        seen.append((name, rows, after))
        rows = after
    return {name: (before.toPandas().set_index("doc_id"), after.toPandas()) for name, before, after in seen}


def test_language_stage_keeps_what_is_known(spark, stages):
    before, after = stages["language_id"]
    assert set(after.doc_id) == {k for k, t in before.text.items() if t and any(c.isalpha() for c in t)}


def test_dedup_stage_keeps_one_of_each_group(stages):
    before, after = stages["simhash_near_dedup"]
    assert set(after.doc_id) == firsts(before.text.to_dict())


def test_decontamination_stage_drops_texts_with_items(spark, stages):
    before, after = stages["benchmark_decontamination"]
    docs = spark.createDataFrame([(int(k), t) for k, t in before.text.items()], "doc_id long, text string")
    found = decontam.contaminated(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).toPandas()
    assert set(before.index) - set(after.doc_id) == set(found.doc)


def test_secret_stage_leaves_no_secret_and_all_rows(stages):
    before, after = stages["secret_scans"]
    encode = secretscan._encoder(secretscan.vocabulary_path())
    assert set(before.index) == set(after.doc_id)
    for row in after.itertuples():
        assert secretscan.base_spans(row.text) == []
        if secretscan.base_spans(before.text[row.doc_id]):
            assert secretscan.MARK in row.text
            assert row.n_chars == len(row.text)
        elif not secretscan.random_spans(before.text[row.doc_id], [], encode, secretscan.CHARS_PER_TOKEN):
            assert row.text == before.text[row.doc_id]


def test_packing_stage_packs_every_text(stages):
    before, after = stages["best_fit_packing"]
    assert set(before.index) == set(after.doc_id)
    assert all(rows.length.sum() <= 4096 for _, rows in after.groupby("sequence_id"))


def test_run_is_the_stages_in_order(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    expected = stages["best_fit_packing"][1]
    assert sorted(map(tuple, rows[columns].values)) == sorted(map(tuple, expected[columns].values))


def test_known_languages_are_those_of_training_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    taught = {r.lang for r in docs.itertuples() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    found = langid.op1_language_id(spark, SF_DIR).toPandas()
    assert set(found.lang_pred) <= taught | {"und"}
