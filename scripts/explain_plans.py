"""Write the physical plans of the headline queries to PLANS.md.

    python scripts/explain_plans.py [sf_dir]

Plans are Spark's ``explain()`` output before execution (AQE may still
coalesce partitions or switch a join at run time).  Only operator lines are
kept; long attribute lists are cut.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.operators import metrics  # noqa: E402
from tessera.plans import catalog  # noqa: E402
from tessera.session import get_spark  # noqa: E402
from tessera.sources import fixtures as fx  # noqa: E402


def plan_text(df) -> str:
    txt = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for line in txt.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        lines.append(line[:160])
    return "\n".join(lines)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    hr = fx.hyp_ref(spark, sf_dir)
    items = [
        ("A4 preparation report over line pairs", catalog.q_a4_prep_report_lines(spark, sf_dir)),
        ("D1 exact split", catalog.q_d1_split(spark, sf_dir)),
        ("T11 word encode (both sides)", catalog.q_t11_encode(spark, sf_dir)),
        ("E7 examples", catalog.q_e7_examples(spark, sf_dir)),
        ("M2 WER", metrics.wer(hr, by=["lang"])),
        ("M3 BLEU", metrics.bleu(hr, by=["lang"], id_col="id")),
    ]
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/explain_plans.py` on `{sf_dir}`, shuffle partitions "
           f"{spark.conf.get('spark.sql.shuffle.partitions')}, before execution (AQE re-plans at run time).", ""]
    for title, df in items:
        out += [f"## {title}", "", "```", plan_text(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
