"""Scorers as plug-ins: two in one pass, fallback, a cache, and rows that cannot be scored."""

import pytest

from sievecraft.operators import judge

ROWS = [
    (1, "q one", "alpha beta", '["alpha", "gamma", "alpha"]', None),
    (2, "q  two", "alpha beta", "", None),  # from the cache
    (3, "q three", "alpha", "", "- alpha beta\n- delta"),
    (4, "", "alpha", '["alpha"]', None),
    (5, "q five", "  ", '["alpha"]', None),
    (6, None, None, None, None),
    (7, "q seven", "alpha", "", None),
]


def test_policy_rewards(spark):
    rows = spark.createDataFrame(ROWS, "rec int, query string, answer string, a string, b string")
    cache = spark.createDataFrame([("q two", '["beta", "alpha"]'), ("q two", '["beta"]'), ("q", "x")], "key string, criteria string")
    # Knows criteria of up to five letters only; the fallback judges the others.
    short = judge.vectorised(lambda query, answer, criterion: (criterion.str.len() / 10).where(criterion.str.len() <= 5))
    nothing = judge.vectorised(lambda query, answer, criterion: criterion.str.len().where(criterion.isna()))
    out = judge.policy_rewards(rows, ["a", "b"], {"keyword": judge.keyword_scorer, "mixed": judge.with_fallback(short, judge.keyword_scorer), "none": nothing}, cache)
    got = {r["rec"]: (r["n_criteria"], r["keyword"], r["mixed"], r["none"]) for r in out.collect()}
    want = {1: (2, 0.5, 0.5, 0.0), 2: (1, 1.0, 0.4, 0.0), 3: (2, 0.25, 0.5, 0.0), **{k: (0, -1.0, -1.0, -1.0) for k in (4, 5, 6, 7)}}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert judge.policy_rewards(rows.limit(0), ["a"], {"keyword": judge.keyword_scorer}).count() == 0
