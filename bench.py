"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loomline.plans import catalogue
from loomline.session import get_session

HEADLINE = [
    "bm25_top5", "vector_ip_top5", "fuse_rrf", "quota_select", "chunk_fixed_words", "chunk_pack_sentences", "chunk_sentences", "set_keep_first", "set_id_conflicts",
    "contains_align", "agg_pass_at_k", "agg_grouped_and_overall", "context_budget", "metric_token_f1", "str_normalize_answer", "html_generic_page",
    "events_tumbling", "merge_datasets", "flow_retrieve_and_read",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total wall clock of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
