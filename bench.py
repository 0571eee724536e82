"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom.plans import catalog  # noqa: E402
from tallyloom.plans.registry import forget_shared  # noqa: E402
from tallyloom.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_perplexity_by_quality",
    "lm_1_ngram_counts",
    "lm_3_adjusted_counts",
    "lm_10_interpolate_orders",
    "lm_12_score_tokens",
    "lm_14_corpus_perplexity",
    "prep_4_exact_dedup",
    "prep_5_minhash_signature",
    "prep_6_near_duplicates",
    "prep_15_sample_to_token_budget",
    "prep_21_pack_tokens",
    "ev_6_majority_vote_by_method",
    "ev_15_rerank",
    "cv_8_stratified_split",
    "cv_17_l1_breakdown",
    "st_3_bootstrap_ci",
    "kg_10_answer_questions",
    "kg_27_clean_triples",
    "doc_1_html_paragraphs",
    "trk_1_track_reconnect",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        forget_shared()  # every query pays for its own intermediate tables
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
