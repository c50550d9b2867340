"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    decontaminate,
    fill_middle,
    language,
    lexical_search,
    line_dedup,
    packing,
    quality,
    repeats,
    simhash,
    token_counts,
    token_files,
    url_filter,
    warc,
)
from folioscope.llm.shared import scratch_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its equivalent SQL."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            CHECKS[function.__name__] = sql
        return function

    return add


@query(r"""
WITH split AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
placed AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS w FROM split),
windows AS (
  SELECT doc_id, pos, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o,
         lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS run,
         lead(w, 7) OVER o AS last
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
repeated AS (
  SELECT doc_id, pos FROM
    (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS n
     FROM windows WHERE last IS NOT NULL) WHERE n > 1),
hit AS (
  SELECT doc_id, count(DISTINCT w) AS n FROM
    (SELECT doc_id, unnest(range(pos, pos + 8)) AS w FROM repeated) GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, s.host, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN hit USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f
  FROM judged WHERE host IS NOT NULL GROUP BY host),
sums AS (
  SELECT sum(n) AS n, sum(f) AS f, count(*) - 1 AS free, sum(n * n) AS nn, sum(f * f / n) AS ff,
         sum(f) / sum(n) AS m FROM hosts),
prior AS (
  SELECT m, least(greatest(coalesce(
    (ff - m * f - m * (1 - m) * free) / nullif(m * (1 - m) * (n - nn / n - free), 0),
    0), 1e-4), 0.5) AS share FROM sums),
verdicts AS (
  SELECT host, (f + m * (1 / share - 1)) / (n + (1 / share - 1)) > 0.5 AS host_failed
  FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM judged LEFT JOIN verdicts USING (host)
""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # As many segments as ids, so that very short documents don't leave a sequence half empty.
    limits = packing.Limits(segments=packing.Limits.tokens)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), limits)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query()
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query()
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "archives")
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


@query(r"""
WITH parsed AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest,
         url
  FROM pages),
cut AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parsed),
named AS (
  SELECT *, CASE WHEN host <> '' THEN
      regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') END AS canonical
  FROM cut),
feeds AS (
  SELECT DISTINCT canonical FROM named WHERE contains(url, 'utm_source=') AND canonical IS NOT NULL),
judged AS (
  SELECT *, CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN canonical IN (SELECT canonical FROM feeds) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the pages that were also reached by a feed link."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("url").contains("utm_source="))
    return url_filter.filter_urls(pages, listed, URL_RULES).drop("listed")


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "tokens")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, path)
    return token_files.read_summary(spark, folder)


@query()
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM split),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM placed),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query("""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || doc_id) AS h FROM documents),
numbers AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a,
         ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS share,
         ('0x' || substr(h, 25, 8))::BIGINT % 100 AS turn FROM drawn),
formed AS (
  SELECT doc_id, text, n, least(a, b) AS low, greatest(a, b) AS high,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR share >= 90 THEN 'plain'
              WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
cut AS (
  SELECT *, substr(text, 1, low) AS pre, substr(text, low + 1, high - low) AS mid,
         substr(text, high + 1) AS suf FROM formed),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text
                 WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                 ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM cut),
seams AS (
  SELECT *, instr(output, '<P>') AS p, instr(output, '<S>') AS s, instr(output, '<M>') AS m
  FROM made)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN substr(output, p + 3, s - p - 3) || substr(output, m + 3)
                              || substr(output, s + 3, m - s - 3)
              ELSE substr(output, p + 3, m - p - 3) || substr(output, m + 3)
                   || substr(output, s + 3, p - s - 3) END) AS restored_sha256
FROM seams
""")
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return fill_middle.restore(outputs).drop("text")


@query(r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
lengths AS (SELECT doc_id, found, len(found)::BIGINT AS n FROM words WHERE len(found) > 0),
totals AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM lengths),
counts AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, unnest(found) AS term FROM lengths) GROUP BY ALL),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term, all_docs),
norms AS (SELECT doc_id, 50 + (50 * n * all_docs) // all_terms AS m FROM lengths, totals),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (doc_id)
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
         doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "index")
    index = lexical_search.build_index(table(spark, sf_dir, "documents"), folder)
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))
