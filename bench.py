"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, comma
separated, or "all"; default the headline queries), BENCH_RUNS (default 2: the better run counts,
so that neither start-up nor code generation of the first one is measured).
"""

from __future__ import annotations

import json
import os
import sys
import time

from newsignal.contract.registry import QUERIES
from newsignal.session import local_session


HEADLINE = """
weekly_company_report sector_ranking sentiment_moving_average cross_sector_comparison source_reliability
pairwise_difference market_momentum sector_outperformance time_patterns portfolio_report
recent_company_sentiment daily_sector_trends sector_summary trending_companies sector_overview
search_terms latest_per_company dedupe_articles link_companies clean_text keyword_score ensemble_score
key_phrases new_articles new_scores retention_counts integrity_violations pipeline_run
stream_dedupe stream_daily_trends
""".split()


def timed(query, spark, sf_dir: str, runs: int) -> float:
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "newsignal-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        seconds[name] = timed(QUERIES[name], spark, sf_dir, runs)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
