"""Conversations that ask the same: only those that the SQL gives the cache's criteria have them, and texts without items have none."""

import duckdb
from test_queries import cell

from sievecraft import catalog

SAID = (
    (1, "what now", "- look at it\n- try again"), (2, "what now", "look at it"), (3, "what now", "look at what now"), (4, "what  now\n", "look at the other thing"), (5, "other", "alpha"),
    (6, '""\n\'', "nothing asked"), (10, "only quotes answered", '"\n""'), (13, "only quotes answered", "try again"), (16, "tail \t", "tail alpha"), (19, " tail", "tail beta"), (20, "tail", "tail"),
)


def test_policy_rewards_of_equal_queries(spark, tmp_path):
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [(k, n, role, text) for k, *said in SAID for n, (role, text) in enumerate(zip(("user", "assistant"), said, strict=True))])
    db.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    df = catalog.QUERIES["policy_rewards"](spark, str(tmp_path))
    found = db.execute(catalog.ORACLE_SQL["policy_rewards"])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(map(cell, r)) for r in found.fetchall())
    got = {r["rec"]: r["n_criteria"] for r in df.collect()}
    assert [got[k] for k in (1, 2, 4, 5, 6, 10, 13, 19, 20)] == [2, 0, 2, 0, 0, 0, 0, 1, 0]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want
