"""Every catalogued query against its SQL counterpart in another engine."""

from hashlib import sha256
from pathlib import Path

import duckdb
import pytest

from lintlake.plans.catalogue import queries
from lintlake.plans.oracle import oracle_sql

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_rows(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = [tuple(row[c] for c in columns) for row in frame.collect()]
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert _sorted(ours) == _sorted(theirs)


def test_every_query_but_the_listing_has_sql():
    assert set(queries()) - set(oracle_sql()) == {"tree_listing"}


def test_tree_listing(spark):
    rows = queries()["tree_listing"](spark, SF_DIR).collect()
    files = {f"{name}.parquet": Path(SF_DIR, f"{name}.parquet").read_bytes() for name in TABLES}
    assert {tuple(r) for r in rows} == {(name, len(data), sha256(data).hexdigest()) for name, data in files.items()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
