"""Every item counts in dimension_transition: also one that lies in the second half and at a third place."""

import duckdb
from test_queries import cell

from sievecraft import catalog


def test_each_line_counts(spark, tmp_path):
    db = duckdb.connect()
    for name, key, texts in (("documents", "doc_id", ["a b c\nd e f\nthe old river bridge", "nothing here\nalpha beta", ""]), ("benchmark", "item_id", ["the old river bridge", "nothing here", "left alone"])):
        more = ", lang varchar, source varchar" if name == "documents" else ""
        db.execute(f"CREATE TABLE {name}({key} bigint, text varchar{more})")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?{', NULL, NULL' if more else ''})", list(enumerate(texts)))
        db.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    df = catalog.QUERIES["dimension_transition"](spark, str(tmp_path))
    rows = df.collect()
    assert [sum(r[k] for r in rows) for k in ("total", "recovered", "lost", "retained", "still_blind")] == [3, 1, 0, 1, 1]
    found = db.execute(catalog.ORACLE_SQL["dimension_transition"])
    columns = [d[0] for d in found.description]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in rows) == sorted(tuple(map(cell, r)) for r in found.fetchall())
