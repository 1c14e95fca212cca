"""The driver's contract."""

import __spark_entry__ as entry_module
from tests.conftest import SF


def test_entry(spark):
    df = entry_module.entry(spark)
    assert {"query_id", "rank", "final_score", "text"} <= set(df.columns) and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_queries_equal_their_sql_on_the_smallest_input(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "nation", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    for name in ("c4_c5_chunks", "u3_variants", "r9_r10_r11_r12_retrieve", "a1_a3_broad_context", "e2_reading_order"):
        df = queries[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(repr([r[c] for c in cols]) for r in df.collect())
        cursor = con.execute(sql[name])
        at = {d[0]: i for i, d in enumerate(cursor.description)}
        assert got == sorted(repr([r[at[c]] for c in cols]) for r in cursor.fetchall()), name


def test_search_set_is_every_hundredth_row(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    whole = {r[0] for r in con.sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    for name in ("r2_dense_top", "r3_dense_norm", "r7_rank", "r10_diversify_by_source", "r11_diversify_by_page"):
        df = queries[name](spark, SF)
        cols = sorted(df.columns)
        rows = df.collect()
        assert {r["query_id"] for r in rows} == whole, name
        got = sorted(repr([r[c] for c in cols]) for r in rows)
        cursor = con.execute(sql[name])
        at = {d[0]: i for i, d in enumerate(cursor.description)}
        assert got == sorted(repr([r[at[c]] for c in cols]) for r in cursor.fetchall()), name


def test_ragged_tables_give_their_whole_markdown(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    df = entry_module.queries()["e7_ragged"](spark, SF)
    cols = ["source", "page", "table_ix", "ragged", "markdown"]
    assert df.columns == cols
    rows = sorted(map(tuple, df.collect()), key=repr)
    assert rows == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({entry_module.oracle_sql()['e7_ragged']})").fetchall(), key=repr)
    assert any(r[3] and r[4] is None for r in rows) and any(not r[3] and r[4].count("\n") > 2 for r in rows) and any(r[4] == "" for r in rows)
