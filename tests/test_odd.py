"""Queries and their SQL agree on rows with words that mix alphabets and lines with two bullets."""

import duckdb
import pytest
from test_queries import cell

from sievecraft import catalog

LINES = (
    "Doesó de la", "- a. o rest of the line", "- 1) - x y z", "1. b) Foo bar baz", "ñan the señal anñ is thisé", "Isé it", "Providesé this thing", "solveé the sumé", "és f(x): y", "éfoo(x): y", "should isé", "shouldé is it", "should is the should is", "Statesñ clearlyé",
    "Canñ it be", "satisfies the query intent by é", "the中 content中 should be", "does not applicableé", "Explainsó why", "ésource citationé source", "中the an中 a",
)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at, db = tmp_path_factory.mktemp("odd"), duckdb.connect()
    turn = lambda i: LINES[i % len(LINES)]
    docs = [(i, "\n".join([*LINES[i % len(LINES) :], *LINES[: i % 3]]) if i % 2 else turn(i // 2)) for i in range(120)]
    said = [(i // 2, i % 2, ("user", "assistant")[i % 2], turn(i // 2 + i) + (f"\n{turn(i)}" if i % 3 else "")) for i in range(160)]
    for name, columns, rows in (("documents", "doc_id bigint, text varchar", docs), ("conversations", "conv_id bigint, turn bigint, role varchar, text varchar", said)):
        db.execute(f"CREATE TABLE {name}({columns})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        db.execute(f"COPY {name} TO '{at}/{name}.parquet'")
    return str(at), db


@pytest.mark.parametrize("name", ["dimension_keys", "parse_items", "payload_gold", "response_statements", "polished_items", "surface_rewrites"])
def test_odd(spark, odd, name):
    at, db = odd
    df = catalog.QUERIES[name](spark, at)
    found = db.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(cell, r)) for r in found.fetchall())
