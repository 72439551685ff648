"""Plan properties the scale design depends on (regression guards)."""

import re

from buoyline.operators import history as H
from buoyline.operators import points as PT
from buoyline.operators import rollup as R
from buoyline.operators import state as S
from buoyline.plans.ingest import ingest
from buoyline.sources import fixtures as P
from buoyline.sources import store
from buoyline.sources import tables as TB

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ops(plan):
    """Operator names from the top of the plan down."""
    return re.findall(r"(WindowGroupLimit[^\n]*?(?:Partial|Final)|Exchange|HashAggregate|SortAggregate|"
                      r"TakeOrderedAndProject|Generate)", plan)


def test_history_cuts_before_every_shuffle(spark, tmp_path):
    store.write_points(ingest(TB.raw_messages(spark, SF), P.INGEST_TIME).points, str(tmp_path / "p"))
    pts = store.read_points(spark, str(tmp_path / "p"))
    for per_series in (False, True):
        ops = _ops(_plan(H.history(pts, None, P.HISTORY_FROM, P.HISTORY_TO, 10, per_series=per_series)))
        for i, op in enumerate(ops):
            if op == "Exchange":  # the operator below every shuffle is a partial step
                below = ops[i + 1]
                assert below.endswith("Partial") or below == "HashAggregate", (per_series, ops)


def test_aggregations_are_partial_before_the_shuffle(spark):
    recs = ingest(TB.raw_messages(spark, SF), P.INGEST_TIME)
    for df in (S.latest(recs.records), PT.resolve_wide(recs.points), R.rollup(recs.points)):
        ops = _ops(_plan(df))
        for i, op in enumerate(ops):
            if op == "Exchange" and i + 1 < len(ops) and ops[i + 1] in ("HashAggregate", "SortAggregate"):
                assert ops[i - 1] == ops[i + 1]  # final above, partial below


def test_ingest_stays_in_one_stage_for_multi_split_input(spark, tmp_path, raw_df):
    rows = [(i, "sensors/D/telemetry", '{"device_id":"D","temperature":1}') for i in range(64)]
    src = str(tmp_path / "raw")
    raw_df(rows).repartition(spark.sparkContext.defaultParallelism * 2).write.parquet(src)
    raw = spark.read.parquet(src)
    ops = _ops(_plan(ingest(raw, P.INGEST_TIME).rejects))
    assert "Exchange" not in ops and "Generate" in ops  # no shuffle, the evaluate-once barrier in place
