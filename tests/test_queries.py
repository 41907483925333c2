"""Every registered query with SQL against DuckDB on the small tables."""

import hashlib
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.plans import page_queries, queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, (str, bool)) else round(float(v), 6)

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_matches_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    got = duck.execute(own.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    assert mine == rows(names, got.fetchall())
    assert mine


def test_symbols_are_cleaned_to_the_end_of_a_text(spark, tmp_path):
    text = "x" * 100 + "\uf0b7 \uf041"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = own.QUERIES["symbols_cleaned"](spark, str(tmp_path)).first()
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert (got["cleaned"], got["n_cleaned"]) == (digest("•A✓ " + "x" * 100 + "• A"), 107)
    assert (got["decoded"], got["n_decoded"]) == (digest("\uf0b7\uf041\uf0fc " + text), 107)


def test_every_turn_has_a_page(spark, tmp_path):
    spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 1, "a", "z")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in own.QUERIES["fill_missing_pages"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, "x"), (1, 2, ""), (1, 3, "y"), (1, 4, ""), (2, 1, ""), (2, 2, ""), (2, 3, "z"), (2, 4, "")]


def test_words_of_a_page_are_made_once_for_a_text(spark):
    texts = spark.createDataFrame([(1, "ab cd " * 6)], "doc_id long, text string")
    made = texts.select(page_queries._lines_of(F.col("text")).alias("lines"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [x[:8] for x in made.first()["lines"]] == ["baaaax a", "baaabx c", "baaacx a"]
