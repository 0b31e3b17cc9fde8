"""Tables with nulls, odd texts and extra columns of clashing names, and a DuckDB view of the small test tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string, n_hit long, hash long, topic string, score double"


def odd_rows(texts):
    """Rows with extra columns whose names clash with those that operators use inside."""
    return [(i, t, "en", "s", len(t or ""), -1, -1, "k", -1, -1, "t", -1.0) for i, t in texts]


def odd_table(spark, texts):
    return spark.createDataFrame(odd_rows(texts), SCHEMA)


def duck_tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con
