"""A statement is fixed as often as its SQL fixes it: what two fixes of a sentence leave stays."""

import duckdb
from test_queries import cell

from sievecraft import catalog

LINES = ("does does Is", "Does does was,,", "does does does is it", "does is it", "does does does does it", "Does la su.", "not it", "does not has", "Is is it?")


def test_response_statements_of_repeated_verbs(spark, tmp_path):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id bigint, text varchar)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(k, "\n".join(LINES)) for k in range(28)])
    db.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    df = catalog.QUERIES["response_statements"](spark, str(tmp_path))
    found = db.execute(catalog.ORACLE_SQL["response_statements"])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(map(cell, r)) for r in found.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want
    assert any("should Is." in r[-1] for r in want)
