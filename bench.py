"""Time the headline queries on one scale and print one JSON line."""

import json
import os
import time

from parley.plans import catalog
from parley.session import build_session

HEADLINE = [
    "top_sessions", "utterances", "word_speaker_overlap", "turn_word_coverage", "unintelligible_gaps", "missed_speech_gaps",
    "merge_intervals", "boundary_zones", "duplicate_segments", "garbage_census", "text_word_mismatch", "clean_tokens",
    "apply_corrections", "variant_scan", "name_mentions_in_documents", "family_names", "name_clusters", "identify_speakers",
    "timestamp_drift", "shown_flags", "detection_rollup", "key_scores", "world_outcomes", "intake",
]

#: Heavier queries, timed as well and reported beside the total.
HEAVY = ["name_cards", "inconsistent_names", "canon_flags", "correction_gate", "review_list", "story_assembly", "segmentation_scores",
         "alignment_merge", "control_words"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["session_stats"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the JVM

    def timed(name: str) -> float:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t, 3)

    took = {name: timed(name) for name in HEADLINE}
    heavy = {name: timed(name) for name in HEAVY}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took | heavy,
                      "heavy_total": round(sum(heavy.values()), 3), "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
