"""Every query that SQL can express equals its SQL, row for row, on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    rows = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    select = ", ".join(f'"{c}"' for c in cols)
    assert rows == sorted((tuple(map(plain, r)) for r in duck.sql(f"select {select} from ({entry.oracle_sql()[name]})").fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["subject_kind", "subject_ref", "predicate"]


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(os.path.join(root, "evidentia")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "evidentia.llm" not in text.read()
