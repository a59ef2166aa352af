"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import time

from reviewsieve.plans.queries import QUERIES
from reviewsieve.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "t1_sentences", "n7_sentiment", "f_style", "f_style_docs", "l3_bigrams", "l4_perplexity", "v3_vocab",
    "c3_score", "g3_similarity", "g5_mmr", "a10_aspects", "r1_r4_stats", "c2_fit", "g7_digest", "r6_threshold_grid",
    "r7_report",
]


def main() -> None:
    spark = local_session(CPUS, app="reviewsieve-bench")
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
