"""Write PLANS.md: physical plans of the key queries (python tests/show_plans.py [sf_dir])."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from buoyline.operators import history as H
    from buoyline.operators import legacy as L
    from buoyline.operators import rollup as R
    from buoyline.plans.ingest import ingest, ingest_to
    from buoyline.session import local_session, scratch_path
    from buoyline.sources import fixtures as P
    from buoyline.sources import store
    from buoyline.sources import tables as TB

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    paths = ingest_to(TB.raw_messages(spark, sf), scratch_path(spark, "plans"), P.INGEST_TIME)
    pts = store.read_points(spark, paths["points"])
    ing = ingest(TB.raw_messages(spark, sf), P.INGEST_TIME)
    cases = [
        ("History of one device over the stored points (C1–C3, D1–D5)",
         H.history(pts, P.HISTORY_DEVICE, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT)),
        ("History per series over all devices (X10, F5)",
         H.history(pts, None, P.HISTORY_FROM, P.HISTORY_TO, P.HISTORY_LIMIT, per_series=True)),
        ("Ingest rejects: one parse, filters above the evaluate-once barrier (B1, B7, B13, R3)", ing.rejects),
        ("Latest state per device (G1)", ing.latest()),
        ("Legacy sensor state (G3)", L.sensors(L.classify(TB.legacy_messages(spark, sf)))),
        ("Daily rollup over the stored points (X7)", R.rollup(pts, "1 day")),
    ]
    out = ["# Physical plans of the key queries", "",
           "Generated by `python tests/show_plans.py` on `" + sf + "` (local[8], AQE on; final plans as",
           "Spark prints them before execution). Long expression lists are cut.", ""]
    for title, df in cases:
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln if len(ln) <= 180 else ln[:177] + "..." for ln in plan.split("\n") if ln.strip()]
        out += [f"## {title}", "", "```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
