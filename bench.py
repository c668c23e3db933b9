"""Time the headline queries; print one JSON line.

Each query runs once, whole, into the ``noop`` sink. Training the language profile and the stored
crawl output, from which the export queries start, are timed as entries of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill.plans import catalog  # noqa: E402
from pagemill.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "scan_pages",
    "extract_paragraphs",
    "extract_links",
    "canonical_url",
    "resolve_url",
    "link_audit",
    "allow_deny_domains",
    "regex_rule_join",
    "robots_filter",
    "pages_to_spiders",
    "raw_file_table",
    "drop_report",
    "split_lines",
    "crawl_frontier",
    "ngram_profiles",
    "top_ngrams",
    "detect_paragraph_lang",
    "detect_page_langs",
    "paragraph_rows",
    "page_language_distribution",
    "language_histogram",
    "result_size",
    "chunk_rows",
    "paragraph_messages_chunked",
    "scan_paragraph_csv",
    "dispatch_finalizer",
    "stream_tasks",
    "drop_redelivered",
    "stream_parse",
    "stream_results",
    "html_elements",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = get_spark(
        "pagemill-bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {"session_warmup": timed(lambda: run(spark.range(1000)))}
    times["stage_model"] = timed(lambda: catalog.model(spark, SF_DIR))
    times["stage_crawl_rows"] = timed(lambda: catalog.crawl_rows(spark, SF_DIR))
    times["stage_crawl_files"] = timed(lambda: catalog.crawl_files(spark, SF_DIR))
    for name in HEADLINE:
        times[name] = timed(lambda: run(catalog.QUERIES[name](spark, SF_DIR)))
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()) - times["session_warmup"], 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
