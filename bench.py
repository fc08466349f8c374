"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from siftbook.plans.catalog import QUERIES
from siftbook.session import build_session

HEADLINE = (
    "corpus_preparation", "a11_jats_chunks", "a12_elsevier_items", "b1_strip_header", "b10_contamination_filter", "c3_clean_markup",
    "c23_answer_letter", "c31_shared_substring", "c41_language", "d6_any_key_duplicates", "d10_top_k_retrieval", "d11_passage_match",
    "d12_condition_view", "e2_document_decisions", "e4_drop_repeated_blocks", "e5_upper_median", "e7_question_difficulty",
    "e8_grading_summary", "e9_leaderboard", "e14_earliest_date", "e22_entity_grounding", "f1_last_write_wins", "f4_train_validation",
    "f5_round_robin_shard", "f9_stratified_sample", "f11_top_fraction", "f13_sequence_ids", "f17_section_packing", "h3_drop_copies",
    "h4_content_copies", "i1_context_build", "k2_upsert_by_key",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the executors
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
