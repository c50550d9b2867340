"""Chart specifications embedded in pages: finding, naming, placing and their data."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from folioscope import constants as K
from folioscope.functions import charts as C
from folioscope.functions import dom
from folioscope.functions import text as X
from folioscope.functions.dom import attr

_TOKENS = re.compile("[{}]|" + re.escape(K.CHART_SCHEMA_MARKER))


def _enclosing_objects(page: str) -> list[tuple[int, int]]:
    """(start, end) of the innermost braces around each schema marker, in page order.

    One pass with a stack, so a page full of braces costs its length only.
    """
    stack, wanted, found = [], set(), []
    for token in _TOKENS.finditer(page):
        if token[0] == "{":
            stack.append(token.start())
        elif token[0] == "}":
            if stack:
                start = stack.pop()
                if start in wanted:
                    found.append((start, token.end()))
        elif stack:
            wanted.add(stack[-1])
    return sorted(found)


def chart_candidates(captures: DataFrame, theme_window: int = K.CHART_THEME_WINDOW) -> DataFrame:
    """(page_id, start, raw, before) for each object around a schema marker.

    `before` holds the `theme_window` characters before the object, where its theme is named.
    Pages without a marker are filtered in the JVM and never reach Python.
    """
    schema = T.StructType(
        [
            T.StructField("page_id", captures.schema["page_id"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("raw", T.StringType()),
            T.StructField("before", T.StringType()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("page_id")
            for i, page in enumerate(batch.column("html")):
                text = page.as_py()
                hits = _enclosing_objects(text)
                if hits:
                    columns = [
                        pa.array([ids[i].as_py()] * len(hits), ids.type),
                        pa.array([s for s, _ in hits], pa.int64()),
                        pa.array([text[s:e] for s, e in hits], pa.string()),
                        pa.array(
                            [text[max(0, s - theme_window) : s] for s, _ in hits],
                            pa.string(),
                        ),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns, names=["page_id", "start", "raw", "before"]
                    )

    marked = captures.where(F.contains("html", F.lit(K.CHART_SCHEMA_MARKER)))
    return marked.select("page_id", "html").mapInArrow(scan, schema)


def extract_chart_specs(captures: DataFrame, limit: int | None = None) -> DataFrame:
    """(page_id, chart, start, spec, title, theme, placeholder, left_out).

    spec is a VARIANT. The escaped form of a payload is tried before the raw one; equal
    specs of a page count once. With a `limit`, only the first charts of a page are given,
    and `left_out` says how many more it has.
    """
    candidates = chart_candidates(captures)
    escaped = F.contains("raw", F.lit('\\"'))
    unescaped = F.try_parse_json(F.replace("raw", F.lit('\\"'), F.lit('"')))
    staged = candidates.withColumns(
        {"_a": F.when(escaped, unescaped), "_b": F.try_parse_json("raw")}
    )
    spec = F.when(C.chart_renderable(F.col("_a")), F.col("_a")).when(
        C.chart_renderable(F.col("_b")), F.col("_b")
    )
    themes = F.regexp_extract_all("before", F.lit(K.CHART_THEME), F.lit(1))
    parsed = (
        staged.withColumn("spec", spec)
        .where(F.col("spec").isNotNull())
        .withColumn("json", F.to_json("spec"))
        .withColumn("fingerprint", X.sha_prefix(F.col("json"), 24))
        .withColumn(
            "theme",
            F.coalesce(F.lower(F.get(themes, F.size(themes) - 1)), F.lit(K.CHART_DEFAULT_THEME)),
        )
        .select("page_id", "start", "json", "fingerprint", "theme")
    )
    distinct = parsed.groupBy("page_id", "fingerprint").agg(
        F.min(F.struct("start", "theme", "json")).alias("c")
    )
    order = W.partitionBy("page_id").orderBy("start")
    numbered = distinct.select("page_id", "c.*").withColumn(
        "chart", F.row_number().over(order) - 1
    )
    left_out = F.lit(0).cast("bigint")
    if limit is not None:
        found = F.count("*").over(W.partitionBy("page_id"))
        numbered = numbered.withColumn("_found", found).where(F.col("chart") < limit)
        left_out = F.greatest(F.col("_found") - limit, left_out)
    numbered = numbered.withColumn("left_out", left_out).withColumn("spec", F.parse_json("json"))
    default = F.concat(F.lit(K.CHART_DEFAULT_TITLE), (F.col("chart") + 1).cast("string"))
    titled = numbered.withColumn("title", C.chart_title(F.col("spec"), default))
    return titled.select(
        "page_id",
        F.col("chart").cast("bigint").alias("chart"),
        "start",
        "spec",
        "title",
        "theme",
        C.chart_placeholder(F.col("title"), F.col("chart")).alias("placeholder"),
        "left_out",
    )


def chart_objects(html: Column, theme_window: int = K.CHART_THEME_WINDOW) -> Column:
    """array<struct<start, raw, before>> of the objects around schema markers, in page order.

    Pages without a marker come to Python as nulls.
    """

    @F.arrow_udf("array<struct<start:bigint,raw:string,before:string>>")
    def found(pages: pa.Array) -> pa.Array:
        rows = []
        for page in pages:
            text = page.as_py()
            rows.append(
                [
                    {"start": s, "raw": text[s:e], "before": text[max(0, s - theme_window) : s]}
                    for s, e in _enclosing_objects(text)
                ]
                if text is not None
                else None
            )
        kind = pa.struct([("start", pa.int64()), ("raw", pa.string()), ("before", pa.string())])
        return pa.array(rows, pa.list_(kind))

    return found(F.when(F.contains(html, F.lit(K.CHART_SCHEMA_MARKER)), html))


def page_charts(objects: Column, limit: int | None = None) -> Column:
    """The charts among a page's objects: array<struct<chart, json, title, theme, placeholder>>.

    What extract_chart_specs() finds, inside the row: the escaped form is tried before the raw
    one, equal specs count once, and a `limit` keeps the first charts.
    """

    def read(o: Column) -> Column:
        plain = F.try_parse_json(F.replace(o["raw"], F.lit('\\"'), F.lit('"')))
        forms = F.struct(
            F.when(F.contains(o["raw"], F.lit('\\"')), plain).alias("a"),
            F.try_parse_json(o["raw"]).alias("b"),
        )
        spec = lambda f: F.when(C.chart_renderable(f["a"]), f["a"]).when(
            C.chart_renderable(f["b"]), f["b"]
        )
        themes = F.regexp_extract_all(o["before"], F.lit(K.CHART_THEME), F.lit(1))
        theme = X.let(themes, lambda t: F.coalesce(F.lower(F.get(t, F.size(t) - 1)), F.lit(K.CHART_DEFAULT_THEME)))
        return F.struct(F.to_json(X.let(forms, spec)).alias("json"), theme.alias("theme"))

    charts = F.filter(F.transform(objects, read), lambda c: c["json"].isNotNull())
    first = lambda all_: F.filter(
        all_, lambda c, i: F.array_position(F.transform(all_, lambda x: x["json"]), c["json"]) == i + 1
    )
    distinct = X.let(charts, first)
    if limit is not None:
        distinct = F.slice(distinct, 1, limit)

    def named(c: Column, i: Column) -> Column:
        default = F.concat(F.lit(K.CHART_DEFAULT_TITLE), (i + 1).cast("string"))
        return X.let(
            C.chart_title(F.parse_json(c["json"]), default),
            lambda title: F.struct(
                i.cast("int").alias("chart"),
                c["json"].alias("json"),
                title.alias("title"),
                c["theme"].alias("theme"),
                C.chart_placeholder(title, i).alias("placeholder"),
            ),
        )

    return F.transform(distinct, named)


def chart_rows(specs: DataFrame) -> DataFrame:
    """The data a spec carries, one row per record: (page_id, chart, title, mark, row, record)."""
    name = F.try_variant_get("spec", "$.data.name", "string")
    inline = F.try_variant_get("spec", "$.data.values", "array<variant>")
    sets = F.try_variant_get("spec", "$.datasets", "map<string,array<variant>>")
    named = F.coalesce(F.try_element_at(sets, name), F.get(F.map_values(sets), 0))
    mark = F.coalesce(
        F.try_variant_get("spec", "$.mark.type", "string"),
        F.try_variant_get("spec", "$.mark", "string"),
    )
    return specs.select(
        "page_id",
        "chart",
        "title",
        mark.alias("mark"),
        F.posexplode(F.coalesce(inline, named)).alias("row", "record"),
    )


def chart_slots(nodes: Column) -> Column:
    """array<seq> of the empty boxes inside figures that wait for a chart."""
    height = lambda n: F.regexp_extract(
        attr(n, "style"), r"(?i)(?:^|;)\s*height\s*:\s*(\d+(?:\.\d+)?)px\s*(?:;|$)", 1
    ).try_cast("double")
    waiting = F.filter(
        nodes,
        lambda n: (n["tag"] == "div")
        & (dom.chars(n) == 0)
        & (height(n) >= K.CHART_SLOT_MIN_HEIGHT)
        & ~F.exists(dom.below(nodes, n), lambda x: (x["parent"] == n["seq"]) & (x["tag"] != dom.TEXT))
        & (n["inside"]["figure"] >= 0),
    )
    return F.transform(waiting, lambda n: n["seq"])


def match_chart_slots(pages: DataFrame, charts: DataFrame) -> DataFrame:
    """The Nth chart of a page goes to its Nth slot: (page_id, chart, placeholder, slot_seq)."""
    slots = pages.select("page_id", F.posexplode(chart_slots(F.col("nodes"))).alias("chart", "slot_seq"))
    return charts.select("page_id", "chart", "placeholder").join(
        slots.withColumn("chart", F.col("chart").cast("bigint")), ["page_id", "chart"]
    )


def _image(chart: Column) -> Column:
    return F.concat(
        F.lit("!["),
        F.regexp_replace(chart["title"], r"[\[\]]", ""),
        F.lit("]("),
        chart["local_url"],
        F.lit(")"),
    )


def _flat_title(c: Column) -> Column:
    return F.lower(X.collapse_space(F.regexp_replace(c, r"[*_`~]", "")))


def place_charts(markdown: Column, charts: Column) -> Column:
    """Markdown with its charts, an array<struct<title, local_url, placeholder>> of ≤ 12.

    A chart replaces its placeholder, else follows a line equal to its title, else goes to
    a section at the end.
    """
    start = F.struct(
        markdown.alias("text"),
        F.expr("cast(array() as array<struct<title:string,image:string>>)").alias("pending"),
    )

    def step(acc: Column, chart: Column) -> Column:
        def apply(image: Column) -> Column:
            text, mark = acc["text"], F.coalesce(chart["placeholder"], F.lit(""))
            lines = F.split(text, "\n", -1)
            heads = F.transform(
                lines, lambda s: _flat_title(F.regexp_replace(s, r"^#{1,6}\s+", ""))
            )
            at = F.array_position(heads, _flat_title(chart["title"])).cast("int")
            count = F.size(lines)
            spacer = F.when(at < count, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            tail = F.when(at < count, F.slice(lines, at + 1, count)).otherwise(F.array(F.lit("")))
            inserted = F.array_join(
                F.concat(F.slice(lines, F.lit(1), at), spacer, F.array(image), tail), "\n"
            )
            replaced = F.concat(
                F.substring(text, F.lit(1), F.instr(text, mark) - 1),
                image,
                F.substring(text, F.instr(text, mark) + F.length(mark), F.length(text)),
            )
            present = F.contains(text, image)
            slot = ~present & (mark != "") & F.contains(text, mark)
            below_title = ~present & ~slot & (at > 0)
            waits = ~present & ~slot & (at == 0)
            return F.struct(
                F.when(slot, replaced).when(below_title, inserted).otherwise(text).alias("text"),
                F.when(
                    waits,
                    F.concat(
                        acc["pending"],
                        F.array(F.struct(chart["title"].alias("title"), image.alias("image"))),
                    ),
                )
                .otherwise(acc["pending"])
                .alias("pending"),
            )

        return X.let(_image(chart), apply)

    def finish(acc: Column) -> Column:
        cjk = F.exists(acc["pending"], lambda p: p["title"].rlike(K.CJK_QUALITY))
        section = F.when(cjk, K.CHART_SECTION_CJK).otherwise(K.CHART_SECTION)
        images = F.array_join(F.transform(acc["pending"], lambda p: p["image"]), "\n\n")
        text = X.js_trim(acc["text"])
        known = F.contains(acc["text"], section)
        body = F.when(known, images).otherwise(F.concat(section, F.lit("\n\n"), images))
        return F.when(F.size(acc["pending"]) == 0, text).otherwise(
            X.js_trim(F.concat(text, F.lit("\n\n"), body))
        )

    placed = F.aggregate(charts, start, step, finish)
    return F.when(F.coalesce(F.size(charts), F.lit(0)) <= 0, markdown).otherwise(placed)
