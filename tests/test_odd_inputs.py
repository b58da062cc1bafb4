"""Queries on tables made for them give the rows that DuckDB gives."""

import duckdb

from tallyloom.plans import registry


def same(spark, folder, name: str, **tables: str) -> list[tuple]:
    """The query's sorted rows; ``tables`` are texts of DuckDB's VALUES with their columns, one file each."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = registry.queries()[name](spark, str(folder))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracles()[name]})").fetchall(), key=str)
    return got


def test_accounted_items_with_two_bad_counts_in_a_line_number(spark, tmp_path):
    lines = "SELECT * FROM (VALUES (1, 1, 5.0, 0.08), (1, 1, 5.0, 0.0), (1, 2, 20.0, 0.0), (2, 1, 5.0, 0.0), (2, 1, 5.0, 0.08), (2, 2, 20.0, 0.0)) t(l_orderkey, l_linenumber, l_quantity, l_tax)"
    orders = "SELECT * FROM (VALUES (1, 'O', '5-LOW'), (2, 'O', '5-LOW')) t(o_orderkey, o_orderstatus, o_orderpriority)"
    typed = "SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::DOUBLE AS l_quantity, l_tax::DOUBLE AS l_tax FROM"
    got = same(spark, tmp_path, "accounted_items", lineitem=f"{typed} ({lines})", orders=orders)
    assert [r[3] for r in got] == ["no whole count", "a count below one"]


def test_completed_records_whose_texts_end_with_a_line_end(spark, tmp_path):
    told = "SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 'user', 'a question'), (1, 1, 'assistant', 'Fourteen signs' || chr(10) || repeat('and so on ', 6))) t(conv_id, turn, role, text)"
    assert same(spark, tmp_path, "completed_records", conversations=told) == [("1-0", False, 15 + 59 + 6, 60)]
