"""Merging articles extracts each page once."""

from pyspark.sql import functions as F

from folioscope.operators import extract, pagination
from folioscope.plans import page_queries


def test_pages_are_extracted_once_and_their_own_links_followed(spark):
    captures = page_queries.series(spark, "/root/testdata/sf0.001").where("page_id < 100").cache()
    pages, seen = captures.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = extract.extract(captures, links=True)
    rows = rows.mapInArrow(counted, rows.schema)
    roots = captures.where("page_id % 10 = 1").select("url")
    merged = pagination.follow_and_merge(roots, None, rows, 10)
    found = {r.root_url: r.pages for r in merged.select("root_url", "pages").collect()}
    assert len(found) == pages // 3 and max(found.values()) == 3
    assert merged.where(F.col("pages") == 0).count() == len([n for n in found.values() if n == 0])
    assert seen.value == pages
