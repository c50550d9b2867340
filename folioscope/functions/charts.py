"""Chart specifications held as VARIANT values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions.text import js_trim, non_empty, sha_prefix


def _truthy(spec: Column, key: str) -> Column:
    """Present and neither null, false, 0 nor ''."""
    value = F.try_variant_get(spec, f"$.{key}", "variant")
    shown = F.to_json(value)
    return F.coalesce(
        value.isNotNull() & ~shown.isin("null", "false", "0", '""'), F.lit(False)
    )


def chart_renderable(spec: Column) -> Column:
    schema = F.try_variant_get(spec, "$['$schema']", "string")
    visual = F.lit(False)
    for key in K.CHART_VISUAL_KEYS:
        visual = visual | _truthy(spec, key)
    return F.coalesce(
        F.contains(schema, F.lit("vega-lite"))
        & (_truthy(spec, "data") | _truthy(spec, "datasets"))
        & visual,
        F.lit(False),
    )


def chart_title(spec: Column, default: Column) -> Column:
    """A text title, else title.text, else the default. Spaces around it are dropped."""
    kind = F.schema_of_variant(F.try_variant_get(spec, "$.title", "variant"))
    plain = F.when(kind == "STRING", F.try_variant_get(spec, "$.title", "string"))
    inner = F.schema_of_variant(F.try_variant_get(spec, "$.title.text", "variant"))
    text = F.when(inner == "STRING", F.try_variant_get(spec, "$.title.text", "string"))
    return F.coalesce(non_empty(js_trim(plain)), non_empty(js_trim(text)), default)


def chart_placeholder(title: Column, index: Column) -> Column:
    shown = index.cast("string")
    mark = sha_prefix(F.concat(shown, F.lit(chr(0)), title), 12, upper=True)
    return F.concat(F.lit(K.CHART_PLACEHOLDER + "-"), shown, F.lit("-"), mark)
