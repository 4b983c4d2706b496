"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lokora import catalog
from lokora.session import SCAN_PARTITIONS, local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else [
    "po_entries",
    "po_entries_by_line",
    "po_blocks",
    "corpus_repositories",
    "corpus_table",
    "pairs_unique",
    "file_counts",
    "raw_urls",
    "url_provenance",
    "neighbour_context",
    "filename_context",
    "held_out_groups",
    "exact_sample",
    "assigned_splits",
    "split_matrix",
    "overlap_removed",
    "located_pairs",
    "document_stream",
    "ambiguous_terms",
    "tokenised_corpus",
    "word_counts",
    "joint_dictionary",
    "encoded_corpus",
    "corpus_bleu",
    "character_edit_rate",
    "score_report",
]


def main() -> None:
    spark = local_session(CPUS, "lokora-bench")
    # The tables are single small files: use all cores for their rows.
    spark.conf.set(SCAN_PARTITIONS, CPUS)
    # Start the JVM's code paths on a query that is not timed.
    catalog.QUERIES["repository_keys"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in NAMES:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
