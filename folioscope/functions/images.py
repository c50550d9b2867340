"""Image bytes and image references."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions.text import js_trim


def detect_image_type(body: Column, head_bytes: int = K.IMAGE_HEAD_BYTES) -> Column:
    """File extension by magic bytes, or null; an SVG begins within the first `head_bytes`."""
    head = F.hex(F.substring(body, 1, 12))
    # Only the first bytes matter for SVG; latin-1 keeps every byte readable.
    start = F.lower(js_trim(F.decode(F.substring(body, 1, head_bytes), "ISO-8859-1")))
    start = F.regexp_replace(start, "^\xef\xbb\xbf", "")
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.rlike("^52494646.{8}57454250"), "webp")
        .when(head.rlike("^.{8}66747970(?:61766966|61766973)"), "avif")
        .when(js_trim(start).rlike(r"^(?:<svg|<\?xml)"), "svg")
    )


def expected_extension(content_type: Column) -> Column:
    return (
        F.when(content_type == "image/jpeg", "jpg")
        .when(content_type == "image/svg+xml", "svg")
        .otherwise(F.regexp_replace(content_type, "^image/", ""))
    )


def image_body_ok(body: Column, content_type: Column) -> Column:
    """The bytes are a known image and agree with the declared type."""
    return F.coalesce(
        detect_image_type(body) == expected_extension(content_type), F.lit(False)
    )


def asset_content_type(filename: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in K.ASSET_CONTENT_TYPES.items() for x in p])
    return F.try_element_at(table, F.lower(F.substring_index(filename, ".", -1)))


def safe_link(url: Column, kind: Column) -> Column:
    """Whether a Markdown target may be shown: kind is 'image' or 'link'."""
    target = js_trim(url)
    web = target.rlike("(?i)^https?://")
    own_asset = target.rlike(
        r"^/api/bookmarks/[A-Za-z0-9_-]{1,128}/assets/[a-f0-9]{24}\.(?:png|jpg|gif|webp|avif|svg)$"
    )
    return F.when(kind == "image", web | own_asset).otherwise(
        web | target.startswith("#") | target.rlike("(?i)^mailto:")
    )
