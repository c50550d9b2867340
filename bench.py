"""Times the headline queries; prints one JSON line.

Each query is planned and run to the end (rows are counted by a noop write). `plan` times
are part of the figure. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.

The given tables are single blocks that one core would have to read alone, so they are
first copied into as many files as there are cores; the copy is not timed, and BENCH_COPY=0
leaves it out. Search and list are also timed on an archive written in buckets beforehand.
"""

import json
import os
import tempfile
import time

from folioscope.session import build_session

HEADLINE = (
    "keyword_search",
    "list_page",
    "tag_counts",
    "bookmarks_with_tags",
    "tag_suggestions",
    "card_summaries",
    "reading_minutes",
    "content_quality",
    "normalized_urls",
    "address_networks",
    "tags_replaced",
    "edits_applied",
    "re_extractions_merged",
    "purged_archive",
    "archive_audit",
    "domain_status_report",
    "page_links",
    "full_extraction",
    "bookmark_states",
    "status_per_hour",
    "markdown_export",
    "image_localization_plan",
)


def spread(spark, sf_dir: str, folder: str, files: int) -> str:
    from folioscope.plans.tables import GIVEN

    for name in GIVEN:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    with tempfile.TemporaryDirectory() as folder:
        run(folder)


def run(folder: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from folioscope.plans import catalogue

    copied = sf_dir
    if os.environ.get("BENCH_COPY", "1") != "0":
        copied = spread(spark, sf_dir, folder, int(cpus))
    from folioscope.operators import query
    from folioscope.plans import archive_queries, snapshot_queries

    stored = snapshot_queries.stored(spark, copied)
    found = {
        "keyword_search_stored": lambda: query.live(stored.search(archive_queries.SEARCH)).select("id", "title"),
        "list_page_stored": lambda: stored.list_page(
            q=archive_queries.COMBINED, tag_id="de", status="success", sort="updated", number=2, size=20
        ),
    }
    # One warm-up run, so that the first figure is not the start of the JVM and of Python.
    catalogue.QUERIES["domain_status_report"](spark, copied).count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        df = catalogue.QUERIES[name](spark, copied)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    for name, work in found.items():
        start = time.perf_counter()
        work().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
