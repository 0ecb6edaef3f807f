"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores. Each
query is planned and run to the end (written to the `noop` sink): one warm-up,
then the better of two runs. The item index is built before the searches, as
in use; its cost is the query `item_features`.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from waymark import session  # noqa: E402
from waymark.operators import fast, grep, ranking  # noqa: E402
from waymark.plans import catalog, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "item_features",
    "search",
    "burst_search",
    "grep",
    "best_route",
    "extract_symbols",
    "activity_score",
    "running_max_count",
    "latency_summary",
    "reference_counts",
    "enclosing_declaration",
    "caller_paths",
    "modified_since",
    "apply_changes",
]


def batch_queries(spark, sf):
    """Hundreds of queries taken from the data itself: names and brands."""
    part = tables.load(spark, sf, "part")
    names = part.selectExpr("p_name as query", "'everything' as scope").distinct()
    brands = part.selectExpr("lower(p_brand) as query", "'types' as scope").distinct()
    cut = part.selectExpr("concat(substr(p_name, 1, 3), ' ', substr(p_name, -3)) as query", "'everything' as scope").distinct()
    typed = part.selectExpr("concat(p_name, ' ', lower(p_type)) as query", "'everything' as scope").distinct()
    asked = names.union(brands).union(cut).union(typed)
    out = asked.selectExpr("crc32(concat(scope, query)) as qid", "query", "scope", "20 as max_results")
    return session.cut(out.coalesce(1), "asked")


def many_texts(spark, sf, n=2_000):
    """`n` texts cut out of names, urls and documents: the queries of one large batch."""
    docs = tables.load(spark, sf, "documents").filter("length(text) > 400")
    spots = docs.selectExpr("explode(transform(sequence(1, 40), i -> lower(substr(text, 10 * i, 9)))) as query")
    words = tables.load(spark, sf, "part").selectExpr("explode(array(p_name, concat(p_brand, '.', substr(p_name, 1, 3)))) as query")
    asked = words.union(spots).filter("trim(query) <> '' and query not like '%\\n%' and query not like '%/%'").distinct().limit(n)
    return session.cut(asked.selectExpr("query as qid", "query", "'everything' as scope", "10 as max_results").coalesce(1), "asked")


def run(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn):
    best = None
    fn()
    for _ in range(2):
        t0 = time.perf_counter()
        fn()
        spent = time.perf_counter() - t0
        best = spent if best is None else min(best, spent)
    return round(best, 3)


def once(fn):
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def main():
    spark = session.local_session("bench", CPUS, int(CPUS), shared=os.environ.get("BENCH_SHARED_DIR"))
    spark.sparkContext.setLogLevel("ERROR")
    index = tables.index(spark, SF_DIR)
    items = index.count()
    seconds = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        seconds[name] = timed(lambda: run(fn(spark, SF_DIR)))
        session.clear_cuts(spark)
    asked = batch_queries(spark, SF_DIR)
    n = asked.count()
    seconds["search_batch"] = timed(lambda: run(ranking.search(asked, index)))
    # Large batches through posting lists, beside the total; the lists are built before, as in use.
    texts = many_texts(spark, SF_DIR)
    t0 = time.perf_counter()
    names, lines = tables.name_grams(spark, SF_DIR), tables.text_grams(spark, SF_DIR)
    built = round(time.perf_counter() - t0, 3)
    burst, found = (once(lambda f=f: run(f())) for f in (lambda: fast.fast_search(texts, index, grams=names), lambda: grep.grep(lines, texts)))
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/"),
        "search_batch": {
            "queries": n,
            "items": items,
            "pairs_per_sec": round(n * items / seconds["search_batch"]),
            "ms_per_query": round(1000 * seconds["search_batch"] / n, 3),
        },
        "posting_lists": {"queries": texts.count(), "build": built, "burst_search": burst, "grep": found},
    }))


if __name__ == "__main__":
    main()
