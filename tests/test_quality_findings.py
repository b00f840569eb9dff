from datetime import date

import duckdb

from tidemark import catalogue
from tidemark.plans import table_plans


def test_orders_and_lines_are_sorted_once_in_small_tasks(spark, tmp_path, monkeypatch):
    """Lines without a key, without an order, or of one hot order, as the SQL has them; one ordered pass over so many lines a task."""
    day = lambda k: date(2024, 1, 28 - k % 28)
    keys = [None, None, 1, 2, 2, 9, 9] + [3] * 60
    lines = [(key, k % 7, k % 5, day(k * 11), float(40 + k % 10)) for k, key in enumerate(keys)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_shipdate date, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "O"), (2, "X"), (3, "F"), (3, "F"), (4, "O")], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(table_plans, "LINES_A_TASK", 10)
    got = catalogue.queries()["quality_findings"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == plan.count("Sort [") == 1 and "Join" not in plan and f"{-(-len(lines) // 10)}), REPARTITION_BY_NUM" in plan
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["quality_findings"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and any(r[0] is None for r in want)
