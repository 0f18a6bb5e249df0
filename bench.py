"""Times headline queries: ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from plumbline.operators.index import build_index
from plumbline.operators.shards import build_shards
from plumbline.plans import scatter
from plumbline.queries import QUERIES, latest_records, record_index, record_shards
from plumbline.session import local_session, materialize
from plumbline.sources.dataset import KINDS, generate_records, query_mix
from plumbline.sources.io import records_from_rows

HEADLINE = [
    "postings_records", "term_df_documents", "facet_index_records", "search_word", "search_prefix", "search_typo", "search_two_words", "search_three_words",
    "search_faceted", "facet_counts", "suggest_alternatives", "batch_search_topk", "rerank_hits", "hit_tie_breaks", "latest_wins",
]
PROBLEMS = [f"p{n}_found" for n in range(1, 10)]
_REQUEST = "request_id bigint, query string, page double, hits_per_page double, typo_tolerance boolean, facet_filters array<array<string>>"


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def run_mix(spark, held, mix) -> None:
    rows = [(i, q.query, 0.0, 20.0, True, q.facet_filters) for i, q in enumerate(mix)]
    scatter.search(*held, spark.createDataFrame(rows, _REQUEST)).write.format("noop").mode("overwrite").save()


def indexed(records) -> tuple:
    index = build_index(records)
    return index, build_shards(index)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    # The reference's own workload: 10,000 records, 1,000 mixed queries.
    records = generate_records()
    held: list = []
    given = records_from_rows(spark, records)
    times["build_index_10k_first"] = timed(lambda: indexed(materialize(given, "bench")))  # with the start of the session's workers
    times["build_index_10k"] = timed(lambda: held.extend(indexed(materialize(given, "bench"))))
    mix = query_mix(records)
    run_mix(spark, held, mix[:200])
    times["mix_1000_over_10k"] = timed(lambda: run_mix(spark, held, mix))
    many = query_mix(records, 20_000)
    times["mix_20000_over_10k"] = timed(lambda: run_mix(spark, held, many))
    for kind in KINDS:
        times[f"mix_1000_{kind}_over_10k"] = timed(lambda kind=kind: run_mix(spark, held, [q for q in many if q.kind == kind][:1000]))

    # The tables of the given size.
    current = materialize(latest_records(spark, sf), "bench")
    times["build_index_records"] = timed(lambda: indexed(current))
    record_shards(spark, sf)
    some = [r.asDict() for r in current.select("title", "description", "genres", "year").sample(0.05, seed=1).collect()]
    sf_mix = query_mix([r | {"genres": [g for g in r["genres"] or [] if g]} for r in some])
    times["mix_1000_over_records"] = timed(lambda: run_mix(spark, (record_index(spark, sf), record_shards(spark, sf)), sf_mix))
    queries = dict(QUERIES)
    try:
        from plumbline.llm.queries import QUERIES as more

        queries |= more
    except ImportError:
        pass
    for name in [n for n in [*HEADLINE, *PROBLEMS] if n in queries]:
        times[name] = timed(lambda name=name: queries[name](spark, sf).write.format("noop").mode("overwrite").save())
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")), "queries_per_s_1000": round(1000 / times["mix_1000_over_10k"], 1), "queries_per_s_20000": round(20_000 / times["mix_20000_over_10k"], 1)}))


if __name__ == "__main__":
    main()
