"""The trade view reads the events once, and trade figures read the view once."""

from __future__ import annotations

from fathomline.plans import adapters as A
from fathomline.plans import registry


def _events(spark, folder):
    rows = [(k, f"2024-01-0{1 + k // 9} 00:00:{59 - k % 50:02d}", k % 4, ("click", "error", "view")[k % 3], 1.5 + k, f'{{"k": {k}}}') for k in range(20) if k != 4]
    spark.createDataFrame([*rows, (None, "2024-01-01 00:00:00", 1, "click", 1.0, '{"k": 1}')], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(k, k % 5, 10.0 * k) for k in range(10)], "c_custkey bigint, c_nationkey int, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    return rows


def test_an_operation_closes_at_its_first_event_and_events_are_read_once(spark, tmp_path):
    rows = _events(spark, tmp_path)
    view = A.trades(spark, str(tmp_path))
    assert view._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    first = {}
    for k, ts, *_ in rows:
        first[k // 3] = min(first.get(k // 3, ts), ts)
    assert {r["trade_id"]: str(r["closed_at"]) for r in view.collect()} == {r[0]: first[r[0] // 3] for r in rows}


def test_trade_figures_do_not_derive_the_log_for_each_use(spark, tmp_path):
    _events(spark, tmp_path)
    plan = registry.trade_supporting(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 0
