"""Notes made from the driver's tables."""

from __future__ import annotations

from datetime import date

from vesperline.plans import order_notes as on


def test_clocks_move_as_numbers_and_are_written_as_their_sql_has_them(spark, tmp_path):
    day = date(1995, 3, 4)
    spark.createDataFrame([(1, 5, day, "O", "1-URGENT"), (2, 5, day, "F", "2-HIGH")], "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 7, day, 9.0), (1, 2, day, 7.0), (1, 3, day, None), (1, 4, None, 5.0), (1, 1, date(1995, 3, 9), 50.0)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_shipdate date, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, "M")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    notes = on.order_notes(spark, str(tmp_path))
    text = notes.first().text
    clocks = spark.sql(on.clocks_sql(True)).where("clock_start is not null").orderBy("pos").collect()
    said = " ".join(f"CLOCK: [{r.clock_start}]" + (f"--[{r.clock_end}] => {r.duration}" if r.clock_end and r.duration else "") for r in clocks)
    assert len(clocks) == 4 and f"\n`{said}`\n" in text and text.count("No clock.") == 1
    plan = notes._jdf.queryExecution().optimizedPlan().toString()
    assert "CLOCK" in plan and "CLOCK" not in plan[plan.index("RepartitionByExpression") :]
