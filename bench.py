"""Headline timings: prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is executed completely through the ``noop`` sink (no driver
collect), after one warm-up query.  ``queries`` holds seconds per query;
``rates`` derived throughputs for the BASELINE table.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.operators import bpe, metrics  # noqa: E402
from tessera.plans import catalog  # noqa: E402
from tessera.session import get_spark  # noqa: E402
from tessera.sources import fixtures as fx  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    run(catalog.q_a2_dataset_size(spark, sf_dir))  # warm-up: JVM, codegen, file listing

    n_lines = fx.line_pairs(spark, sf_dir).count()
    n_hr = fx.hyp_ref(spark, sf_dir).count()

    timed("a4_prep_report_lines", lambda: run(catalog.q_a4_prep_report_lines(spark, sf_dir)))
    timed("a4_prep_report", lambda: run(catalog.q_a4_prep_report(spark, sf_dir)))
    timed("d1_split", lambda: run(catalog.q_d1_split(spark, sf_dir)))
    timed("t2_word_counts", lambda: run(catalog.q_t2_word_counts(spark, sf_dir)))
    timed("e7_examples", lambda: run(catalog.q_e7_examples(spark, sf_dir)))

    cp = fx.conv_pairs(spark, sf_dir)
    vocab, merges, rounds = timed("t5_train_bpe", lambda: bpe.train_bpe(cp, "src_text", catalog.BPE_VOCAB))
    lp = fx.line_pairs(spark, sf_dir)
    timed("t9_encode_lines", lambda: run(bpe.encode(lp, "pair_id", "src_text", vocab, merges)))

    hr = fx.hyp_ref(spark, sf_dir)
    timed("m1_cer", lambda: run(metrics.cer(hr, by=["lang"])))
    timed("m2_wer", lambda: run(metrics.wer(hr, by=["lang"])))
    timed("m3_bleu", lambda: run(metrics.bleu(hr, by=["lang"], id_col="id")))
    timed("m4_corpus_bleu", lambda: run(metrics.corpus_bleu(hr, by=["lang"], id_col="id")))
    timed("x1_log_softmax", lambda: run(catalog.q_x1_log_softmax(spark, sf_dir)))
    timed("s1_aligned_roundtrip", lambda: run(catalog.q_s1_aligned_roundtrip(spark, sf_dir)))

    rates["prep_pairs_per_sec"] = round(n_lines / times["a4_prep_report_lines"], 1)
    rates["bpe_rounds"] = rounds
    rates["bpe_sec_per_round"] = round(times["t5_train_bpe"] / max(rounds, 1), 3)
    rates["encode_lines_per_sec"] = round(n_lines / times["t9_encode_lines"], 1)
    metric_sec = times["m1_cer"] + times["m2_wer"] + times["m3_bleu"]
    rates["cer_wer_bleu_pairs_per_sec"] = round(n_hr / metric_sec, 1)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "rates": rates, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
