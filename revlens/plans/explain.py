"""Physical-plan summary of the registered queries.

    python -m revlens.plans.explain [sf_dir] [--query NAME]

Without ``--query`` prints a markdown table: shuffles, single-partition
exchanges, join strategies, top-k / window-limit operators and the columns
each scan reads. With ``--query`` prints ``explain("formatted")`` of one query.
"""

from __future__ import annotations

import argparse
import re

MARKERS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
           "CartesianProduct", "TakeOrderedAndProject", "WindowGroupLimit", "Window ", "Generate",
           "BatchEvalPython", "ArrowEvalPython", "ReusedExchange"]
# Queries that fit a model or run a stream: summarised from their result table only.
SIDE_EFFECT = {"score_test_split", "model_selection", "stream_scoring", "stream_label_counters",
               "stream_throughput", "split_files_roundtrip", "raw_reviews_csv", "stream_replay",
               "stream_batch_counts", "scored_rows", "stream_equals_batch", "test_export", "stats_file",
               "rejected_messages", "stream_redelivery", "traffic_of_stream", "metadata_records", "product_counters_latest"}


def _final_only(plan: str) -> str:
    """Drop the '== Initial Plan ==' sections of adaptive plans (kept for reference by Spark)."""
    out, skip_col = [], None
    for line in plan.splitlines():
        m = re.search(r"[A-Za-z=*(]", line)
        col = m.start() if m else 0
        if skip_col is not None:
            if col >= skip_col:
                continue
            skip_col = None
        if "== Initial Plan ==" in line:
            skip_col = col
            continue
        out.append(line)
    return "\n".join(out)


def summary(df) -> dict:
    """Summary of the final (adaptive) plan, read after the query has run."""
    # Runs this DataFrame's own plan (which becomes final) and counts rows on the executors: nothing is collected.
    df._jdf.queryExecution().toRdd().count()
    plan = _final_only(df._jdf.queryExecution().executedPlan().toString())
    plan = re.sub(r"ReusedExchange \[[^\]]*\], Exchange", "ReusedExchange", plan)
    shuffles = re.findall(r"(?<!Reused)Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)
    scans = [len(x.split(",")) for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
    found = {m.strip(): plan.count(m) for m in MARKERS if plan.count(m)}
    return {"shuffles": len(shuffles), "single": shuffles.count("SinglePartition"), "ops": found, "scans": scans}


def main(argv=None) -> None:
    from revlens.plans import catalog, catalog_records, catalog_store, catalog_streams  # noqa: F401 - the others add their queries to the registry
    from revlens.session import checkpoint_dir, get_session
    ap = argparse.ArgumentParser()
    ap.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    ap.add_argument("--query")
    a = ap.parse_args(argv)
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    qs = catalog.all_queries()
    if a.query:
        qs[a.query](spark, a.sf_dir).explain("formatted")
        return
    print("| query | shuffles | single-partition | operators | columns per scan |")
    print("| --- | --- | --- | --- | --- |")
    for name, fn in qs.items():
        if name in SIDE_EFFECT:
            print(f"| {name} | - | - | runs a fit, a stream or a file round trip | - |")
            continue
        s = summary(fn(spark, a.sf_dir))
        ops = ", ".join(f"{k} x{v}" for k, v in s["ops"].items()) or "-"
        print(f"| {name} | {s['shuffles']} | {s['single']} | {ops} | {s['scans']} |")


if __name__ == "__main__":
    main()
