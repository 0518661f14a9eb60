"""Time the headline queries and print one JSON line.

queries: registered queries over the raw tables, relations derived anew in each run.
stored: the same operators over layouts written beforehand, as a store that is loaded once and
queried often; layout_sec is what writing them took. sweeps: by size of context and document list.
"""

import json
import os
import time

from pyspark.sql import functions as F

from tessera.operators import bitmaps, division, encode, paths, topk
from tessera.plans import core
from tessera.session import local_session
from tessera.shared import new_folder
from tessera.sources import generators, layout
from tessera.sources.relations import load_da, load_dt

HEADLINE = ["docs_in_context", "docs_in_context_bitmap", "topk_terms_in_docs", "topk_terms_in_context", "topk_tf_in_docs", "topk_tf_in_doc_set", "topk_tf_in_context", "tf_sum_per_term", "cooccurrence_count", "cooccurrence_tf", "authors_in_docs", "author_reach", "set_intersect", "rle_encode", "sum_over_rle", "topk_tf_in_context_tokens"]


def best(make, runs: int = 3) -> float:
    took = []
    for _ in range(runs):
        t = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    return round(min(took), 4)


def stored(spark, sf: str) -> dict:
    own = core.parameters(sf)
    ctx = list(own["context"])
    t = time.perf_counter()
    dt, da = load_dt(spark, sf), load_da(spark, sf)
    kept = layout.bucketed(dt, da)
    by_term, by_doc = layout.ColumnStore.write(dt, "term"), layout.ColumnStore.write(dt, "doc")
    folder, runs = new_folder(spark, "bitmaps"), new_folder(spark, "runs")
    bitmaps.save(division.posting_bitmaps(dt), folder)
    encode.rle_sorted(dt, "term").write.parquet(runs)
    took = time.perf_counter() - t
    bag = core._bag(spark, sf)
    found = {
        "docs_in_context": best(lambda: layout.docs_in_context(by_term, ctx)),
        "docs_in_context_bitmap": best(lambda: division.count_docs_in_context_bitmap(bitmaps.load(spark, folder, ctx), ctx)),
        "topk_terms_in_docs": best(lambda: topk.topk_terms(kept.dt_doc, bag, core.K)),
        "topk_tf_in_docs": best(lambda: topk.topk_tf(kept.dt_doc, bag, core.K)),
        "topk_tf_in_doc_set": best(lambda: topk.topk_tf_set(kept.dt_doc, bag, core.K)),
        "tf_sum_per_term": best(lambda: topk.tf_sum_per_term(kept.dt_doc, bag)),
        "cooccurrence": best(lambda: layout.cooccurrence(by_doc, by_term, own["seed"])),
        "authors_in_docs": best(lambda: paths.authors_in_docs(kept.da_doc, bag)),
        "author_reach": best(lambda: paths.author_reach(kept.dt_doc, kept.da_doc, own["author"], kept.dt_term)),
        "sum_over_rle": best(lambda: encode.sum_over_rle(spark.read.parquet(runs))),
    }
    sweeps = {}
    terms = generators.parameter_lists([1, 5, 10, 100, 1000], max(dt.agg(F.max("term")).first()[0], 1), 123)
    for n, ids in terms.items():
        sweeps[f"docs_in_context/{n} terms"] = best(lambda: division.docs_in_context(kept.dt_term, ids), 2)  # noqa: B023
    docs = generators.parameter_lists([10, 1000, 100_000], max(dt.agg(F.max("doc")).first()[0], 1), 123)
    for n, ids in docs.items():
        listed = spark.createDataFrame([(i,) for i in ids], "doc long")
        sweeps[f"topk_tf/{n} docs"] = best(lambda: topk.topk_tf(kept.dt_doc, listed, core.K), 2)  # noqa: B023
    kept.drop()
    return {"stored": found, "layout_sec": round(took, 2), "sweeps": sweeps}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: best(lambda: core.QUERIES[name](spark, sf)) for name in HEADLINE}  # noqa: B023
    more = stored(spark, sf)
    print(json.dumps({"metric": "total of the best of three runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf} | more))


if __name__ == "__main__":
    main()
