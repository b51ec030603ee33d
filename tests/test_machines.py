import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.machines import state_fold

_RULES = {
    "open": {"idle": "one", "one": "two"},
    "close": {"two": "one", "one": "idle"},
    "reset": "idle",
    None: {"two": "stuck"},
}


def _by_hand(symbols):
    state, out = "idle", []
    for s in symbols:
        rule = _RULES.get(s, {})
        state = rule if isinstance(rule, str) else rule.get(state, state)
        out.append(state)
    return out


@pytest.mark.parametrize("group_rows", [1, 3, 50, None])
def test_states_do_not_depend_on_blocks(spark, group_rows):
    random.seed(3)
    words = ["open", "open", "close", "reset", "other", None]
    data = [(g, i, random.choice(words)) for g, n in ((1, 60), (2, 1), (None, 12)) for i in range(n)]
    df = spark.createDataFrame(data, "g int, i int, s string").repartition(3)
    out = state_fold(df, "state", _RULES, "idle", "s", ["g"], ["i"], group_rows=group_rows)
    assert out.columns == ["g", "i", "s", "state"]
    for g in (1, 2, None):
        mine = sorted((r for r in out.collect() if r.g == g), key=lambda r: r.i)
        assert [r.state for r in mine] == _by_hand([s for h, _, s in data if h == g])


def test_one_group_lies_in_many_tasks(spark):
    df = spark.range(400).select(F.lit(1).alias("g"), "id", F.expr("if(id % 7 = 0, 'open', 'close')").alias("s"))
    out = state_fold(df, "state", _RULES, "idle", "s", ["g"], ["id"], group_rows=20)
    assert [r.state for r in out.orderBy("id").collect()] == _by_hand(["open" if i % 7 == 0 else "close" for i in range(400)])


def test_odd_inputs(spark):
    df = spark.createDataFrame([(1, 1, "open", "x"), (1, 1, "open", "x")], "g int, i int, s string, state string")
    out = state_fold(df, "state", _RULES, "idle", "upper(s)", ["g"], ["i"], group_rows=1)
    assert rows(out, "g", "i", "s", "state") == [(1, 1, "open", "idle")] * 2
    out = state_fold(df, "state", _RULES, "idle", F.col("s"), ["g"], ["i"], group_rows=1)
    assert rows(out, "state") == [("one",), ("two",)]
    assert state_fold(df.limit(0), "state", _RULES, "idle", "s", ["g"], ["i"]).collect() == []
    assert rows(state_fold(df, "n", {}, "only", "s", [], ["i"], group_rows=1), "n") == [("only",)] * 2
    with pytest.raises(ValueError, match="states"):
        state_fold(df, "n", {"a": {str(i): "z" for i in range(5000)}}, "z", "s", ["g"], ["i"])
