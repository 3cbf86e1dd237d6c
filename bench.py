"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tonearm import plans
from tonearm.session import local_session

# One or two per part of the library; each is written to a no-op sink in full.
HEADLINE = (
    "itemknn_neighbors",
    "itemknn_recommend",
    "itemknn_loo_metrics",
    "itemknn_grid",
    "popularity_loo",
    "coldstart_popularity_metrics",
    "mips_topk",
    "warm_recs",
    "cold_recs",
    "embedding_loo_metrics",
    "als_recs",
    "affinity_scores",
    "like_state",
    "challenge_progress",
    "song_features",
    "item_feature_tags",
    "encode_interactions",
    "pareto_head",
    "split_seed_n",
    "search_ngram_documents",
    "external_flags",
    "stream_affinity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM
    names = os.environ.get("BENCH_QUERIES")
    times = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        plans.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("/sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
