from __future__ import annotations

from quarrylight.functions import surface


def test_postings_of_a_column_read_each_text_once_and_move_none(spark):
    surface.register(spark)
    texts = spark.createDataFrame([(1, "b A a_1, a  b\nB"), (2, "b A a_1, a  b\nB"), (3, None), (4, ""), (5, "-"), (6, "w " * 50_000 + "end")], "id int, text string")
    found = spark.sql("SELECT id, p.* FROM {d} AS d, LATERAL ql_postings(d.text) AS p", d=texts)
    same = [("a", 2, 2), ("a_1", 1, 3), ("b", 3, 1)]
    assert sorted(map(tuple, found.collect())) == [(1, *x) for x in same] + [(2, *x) for x in same] + [(6, "end", 1, 50_001), (6, "w", 50_000, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
