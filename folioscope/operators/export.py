"""Export of articles as Markdown files and as portable bundles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.query import attach_tags
from folioscope.schema import Archive


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _front_matter() -> Column:
    line = lambda key, value: F.concat(F.lit(f"{key}: "), X.json_string(value))
    cover = F.col("cover_image_url")
    tags = F.transform("tags", lambda t: F.concat(F.lit("  - "), X.json_string(t["name"])))
    lines = F.flatten(
        F.array(
            F.array(
                F.lit("---"),
                line("title", F.col("title")),
                line("source", F.col("url")),
                line("domain", F.col("domain")),
            ),
            F.when(
                F.coalesce(cover, F.lit("")) != "", F.array(line("cover_image", cover))
            ).otherwise(F.array().cast("array<string>")),
            F.array(line("saved_at", iso_millis(F.col("created_at"))), F.lit("tags:")),
            tags,
            F.array(F.lit("---"), F.lit("")),
        )
    )
    return F.array_join(lines, "\n")


def export_markdown(archive: Archive, df: DataFrame | None = None) -> DataFrame:
    """(id, filename, content) per bookmark; file names that collide get the id added."""
    df = archive.bookmarks if df is None else df
    tagged = attach_tags(df, archive)
    named = tagged.withColumn("_stem", X.safe_filename(F.col("title")))
    # Counted with partial aggregation; one title on many bookmarks is a single row here.
    unique = (
        named.groupBy("_stem").agg(F.count("*").alias("_n"), F.min("id").alias("id"))
        .where(F.col("_n") == 1)
        .select("id", F.lit(True).alias("_alone"))
    )
    content = F.concat(
        _front_matter(),
        F.lit("# "),
        F.col("title"),
        F.lit("\n\n"),
        F.col("markdown_content"),
        F.lit("\n"),
    )
    stem = F.when(F.col("_alone"), F.col("_stem")).otherwise(
        F.concat(F.col("_stem"), F.lit("-"), F.col("id"))
    )
    return named.join(unique, "id", "left").select(
        "id", F.concat(stem, F.lit(".md")).alias("filename"), content.alias("content")
    )


def portable_links(content: Column, bookmark_id: Column) -> Column:
    """Links to the bookmark's own assets made relative."""
    own = F.concat(
        F.lit("/api/bookmarks/"),
        bookmark_id,
        F.lit(r"/assets/([a-f0-9]{24}\.(?:png|jpg|gif|webp|avif|svg))"),
    )
    return F.regexp_replace(content, own, F.lit("assets/$1"))


def export_bundle(exported: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, path, kind, content): the text and one row per asset file of each bookmark."""
    texts = exported.select(
        "id",
        F.col("filename").alias("path"),
        F.lit("text").alias("kind"),
        portable_links(F.col("content"), F.col("id")).alias("content"),
    )
    files = assets.select(
        F.col("bookmark_id").alias("id"),
        F.concat(F.lit("assets/"), F.col("filename")).alias("path"),
        F.lit("asset").alias("kind"),
        F.lit(None).cast("string").alias("content"),
    )
    present = exported.select("id")
    return texts.unionByName(files.join(present, "id", "left_semi"))


def write_export_lines(exported: DataFrame, path: str) -> None:
    """Write the exported files as JSON lines (id, filename, content), by a hash of the id."""
    (
        exported.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(256)))
        .select("bucket", F.to_json(F.struct("id", "filename", "content")).alias("value"))
        .write.partitionBy("bucket")
        .text(path)
    )
