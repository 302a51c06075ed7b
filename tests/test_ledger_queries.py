"""The ledger queries find something, and the newest event is on the first page."""
import duckdb

from partweave.bindings import registry


def test_ledger_queries(spark, sf_dir):
    queries, sql = registry()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    for name in ("a4_ledger_search_text", "p8_ledger_newest"):
        got = [tuple(r) for r in queries[name](spark, sf_dir).collect()]
        assert got and got == con.sql(sql[name]).fetchall()
    assert got[0][0] == con.sql("SELECT max(event_id) FROM events").fetchall()[0][0]
