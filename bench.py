"""Times the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidentia.operators import communities as C
from evidentia.operators import graph as G
from evidentia.operators import retrieval as R
from evidentia.plans.queries import QUERIES
from evidentia.session import local_session, written
from evidentia.sources.tables import synthetic

HEADLINE = (
    "r1_chunks", "r10_vector_rank", "t1_vector_top", "r12_rrf", "r5_merge_edges", "r6_prune", "r8_local_nodes",
    "a10_degrees", "a15_membership", "a17_condense", "a3_per_model", "st2_admitted", "r22_summary",
)


def timed(run) -> float:
    begin = time.perf_counter()
    run()
    return round(time.perf_counter() - begin, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


#: Runs of each capacity path; the mean is told as its time.
ITERATIONS = 3


def repeated(name: str, run, out: dict[str, list[float]]) -> None:
    times = [timed(run) for _ in range(ITERATIONS)]
    out[name] = [round(sum(times) / len(times), 3), min(times), max(times)]


def capacity(spark: SparkSession) -> dict[str, list[float]]:
    """Mean, least and most seconds of the capacity hot paths at the published sizes: scan and cosine, keyword ranking,
    fusion of 200 candidates, seeds and two hops, and two levels of communities."""
    out: dict[str, list[float]] = {}
    for chunks, entities, edges in ((2_000, 200, 600), (5_000, 500, 1_500), (20_000, 2_000, 6_000)):
        made = {k: written(v, f"bench-{k}") for k, v in synthetic(spark, chunks, entities, edges).items()}
        query = written(made["chunks"].where("chunk_id = 0").select(F.lit(1).cast("bigint").alias("query_id"), F.col("embedding").alias("qvec"), F.lit("which synthetic slice 17").alias("question")), "bench-query")
        repeated(f"cosine_{chunks}", lambda m=made, q=query: R.vector_top(R.vector_scores(q, m["chunks"]), 20).collect(), out)
        few = written(made["chunks"].where("chunk_id < 200"), "bench-few")
        repeated(f"keyword_200_of_{chunks}", lambda f=few, q=query: R.keyword_rank(R.hybrid_scores(q, f)).collect(), out)
        scored = R.hybrid_scores(query, few)
        repeated(f"rrf_200_of_{chunks}", lambda s=scored: R.fuse(s, {}, 20).collect(), out)
        asked = spark.createDataFrame([(1, 1, "what links Alpha-10 and Beta-11?")], "query_id long, kb_id long, question string")
        repeated(f"two_hops_{entities}", lambda m=made, a=asked: [x.collect() for x in G.expand(G.seeds(a, m["entities"]), m["relationships"])], out)
        repeated(f"communities_{entities}", lambda m=made: drain(C.detect(m["entities"], m["relationships"])), out)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    drain(spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count())  # compile and load classes once
    times = {name: timed(lambda n=name: drain(QUERIES[n](spark, folder))) for name in HEADLINE}
    paths = capacity(spark)
    times |= {name: mean for name, (mean, _, _) in paths.items()}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1], "mean_min_max": paths}))


if __name__ == "__main__":
    main()
