"""URL column expressions: parsing, normalising, resolving, paging and image rules.

Everything is built from Catalyst expressions. Only host names outside ASCII need
Python (IDNA), and those rows alone carry a value into the vectorised function.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope import constants as K
from folioscope.functions.text import collapse_space, js_trim, let, non_empty

_URL = (
    r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*(?:([^/\\?#]*)@)?(\[[^\]/\\?#]*\]|[^:/\\?#]*)"
    r"(?::([0-9]*))?((?:[/\\][^?#]*)?)(\?[^#]*)?(#.*)?$"
)
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_BAD_HOST = r"[\x00-\x20#%/<>?@\\^|\[\]]"


def _clean(raw: Column) -> Column:
    """Drop what a URL parser ignores: outer blanks and inner tabs and line breaks."""
    return F.regexp_replace(js_trim(raw), r"[\t\r\n]", "")


def _parse(raw: Column) -> Column:
    """struct<raw, scheme, user, host, port, path, query, fragment>; '' where absent.

    Everything but raw and scheme is '' for text that is no hierarchical URL.
    """

    def parts(url: Column) -> Column:
        names = ("user", "host", "port", "path", "query", "fragment")
        groups = [F.regexp_extract(url, _URL, i).alias(n) for i, n in enumerate(names, 2)]
        groups[1] = F.lower(F.regexp_extract(url, _URL, 3)).alias("host")
        scheme = F.lower(F.regexp_extract(url, _SCHEME, 1)).alias("scheme")
        return F.struct(url.alias("raw"), scheme, *groups)

    return let(_clean(raw), parts)


def _parse_strict(raw: Column) -> Column:
    """Like _parse(), with numeric hosts in their dotted form."""
    return let(_parse(raw), lambda u: u.withField("host", _canonical_host(u["host"])))


def _ipv4_part(part: Column) -> Column:
    """Numeric value of one host part in decimal, octal (0…) or hex (0x…)."""
    return (
        F.when(
            part.rlike("^0x[0-9a-f]*$"),
            F.conv(F.concat(F.lit("0"), F.substring(part, 3, 32)), 16, 10),
        )
        .when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10))
        .when(part.rlike("^[0-9]{1,18}$"), part)
        .cast("decimal(20,0)")
    )


def _canonical_host(host: Column) -> Column:
    """Dotted form of hosts such as 0x7f.1 or 2130706433; other hosts unchanged.

    A numeric host that is no address becomes '' and is refused later.
    """
    numeric = host.rlike(r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+))*\.?$")
    weights = F.array(*[F.lit(256**k) for k in (3, 2, 1, 0)])

    def number(parts: Column) -> Column:
        count = F.size(parts)
        return F.aggregate(
            F.sequence(F.lit(0), count - 1),
            F.when(count <= 4, F.lit(0)).cast("decimal(20,0)"),
            lambda acc, i: (
                acc
                + _ipv4_part(F.get(parts, i))
                * F.when(i == count - 1, F.lit(1)).otherwise(F.get(weights, i))
            ).cast("decimal(20,0)"),
        ).cast("bigint")

    def dotted(value: Column) -> Column:
        octets = [F.shiftrightunsigned(value, s) % 256 for s in (24, 16, 8, 0)]
        return F.when(
            value.between(0, 2**32 - 1), F.concat_ws(".", *[o.cast("string") for o in octets])
        ).otherwise("")

    address = let(let(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), dotted)
    return F.when(numeric, address).otherwise(host)


def _port_digits(u: Column) -> Column:
    return F.regexp_replace(u["port"], "^0+(?=[0-9])", "")


def _port(u: Column) -> Column:
    """`:port`, or '' for none and for the default one."""
    default = F.when(u["scheme"] == "https", "443").otherwise("80")
    digits = _port_digits(u)
    return F.when((digits == "") | (digits == default), F.lit("")).otherwise(
        F.concat(F.lit(":"), digits)
    )


def _usable(u: Column) -> Column:
    """True for an absolute http(s) URL with a valid host and port."""
    digits = _port_digits(u)
    # Compared as text of equal length, because most ports are '' and no number.
    port_ok = (F.length(digits) < 5) | ((F.length(digits) == 5) & (digits <= "65535"))
    host_ok = F.when(u["host"].startswith("["), u["host"].rlike(r"^\[[0-9a-f:.]+\]$")).otherwise(
        (u["host"] != "") & ~u["host"].rlike(_BAD_HOST)
    )
    return F.coalesce(
        u["scheme"].isin("http", "https") & host_ok & port_ok,
        F.lit(False),
    )


def _error(u: Column) -> Column:
    return (
        F.when(F.coalesce(u["scheme"], F.lit("")) == "", "INVALID_URL")
        .when(~u["scheme"].isin("http", "https"), "UNSUPPORTED_PROTOCOL")
        .when(~_usable(u), "INVALID_URL")
        .when(u["user"].rlike("[^:]"), "INVALID_URL")
    )


def is_web_url(url: Column) -> Column:
    return let(_parse(url), _usable)


# --- serialising ----------------------------------------------------------------


def _percent_encode(text: Column, unsafe: str) -> Column:
    """Percent-encode the characters matched by `unsafe`; the common case is a no-op."""
    encoded = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda ch: F.when(
                ch.rlike(unsafe), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


_PATH_UNSAFE = r"""[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e\x25]|\^"""
_QUERY_UNSAFE = r"""[^\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e]"""
_FRAGMENT_UNSAFE = r"""[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e]"""
_DOT_UP = r"(?i)^(?:\.|%2e)(?:\.|%2e)$"
_DOT_HERE = r"(?i)^(?:\.|%2e)$"
_ENDS_IN_DOTS = r"(?i)/(?:\.|%2e){1,2}$"
_HAS_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"


def _resolve_dots(path: Column) -> Column:
    """Remove `.` and `..` segments."""
    kept = F.aggregate(
        F.slice(F.split(path, "/"), F.lit(2), F.length(path) + 1),
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(
            s.rlike(_DOT_UP), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(s.rlike(_DOT_HERE), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ended = F.when(path.rlike(_ENDS_IN_DOTS), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    resolved = F.concat(F.lit("/"), F.array_join(ended, "/"))
    return F.when(path.rlike(_HAS_DOTS), resolved).otherwise(path)


def _path(raw: Column) -> Column:
    rooted = F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "^/?", "/")
    return let(_percent_encode(rooted, _PATH_UNSAFE), _resolve_dots)


def _origin(u: Column, host: Column | None = None) -> Column:
    return F.concat(
        u["scheme"], F.lit("://"), u["host"] if host is None else host, _port(u)
    )


def _serialize(u: Column, fragment: bool, host: Column | None = None) -> Column:
    parts = [
        _origin(u, host),
        _path(u["path"]),
        _percent_encode(u["query"], _QUERY_UNSAFE),
    ]
    if fragment:
        parts.append(_percent_encode(u["fragment"], _FRAGMENT_UNSAFE))
    return F.concat(*parts)


def url_path(url: Column) -> Column:
    return let(_parse(url), lambda u: F.when(_usable(u), _path(u["path"])))


def _query(u: Column) -> Column:
    return F.substring(u["query"], F.lit(2), F.length(u["query"]))


# --- admission and normal form ----------------------------------------------------


def url_error(raw: Column) -> Column:
    """Null for an admissible URL, else INVALID_URL or UNSUPPORTED_PROTOCOL."""
    return let(_parse_strict(raw), _error)


def normalize_url(raw: Column) -> Column:
    """Serialised URL without fragment; null where url_error() is set."""
    return let(
        _parse_strict(raw), lambda u: F.when(_error(u).isNull(), _serialize(u, fragment=False))
    )


@F.pandas_udf(StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    def encode(host):
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return hosts.map(encode, na_action="ignore")


def with_normalized_url(
    df: DataFrame,
    url: str,
    into: str = "normalized_url",
    error: str | None = None,
    domain: str | None = None,
) -> DataFrame:
    """Add the normal form of a column, on request also its error code and host name.

    The address is taken apart once. International hosts get their ASCII form: only those
    travel to Python, all other rows pass a null. The stages are separate projections, as
    a Python function takes plain columns only.
    """
    staged = df.withColumn("_u", _parse_strict(F.col(url)))
    staged = staged.withColumns(
        {
            "_bad": _error(F.col("_u")),
            "_foreign": F.when(F.col("_u.host").rlike(r"[^\x00-\x7f]"), F.col("_u.host")),
        }
    )
    staged = staged.withColumn("_ascii", _idna(F.col("_foreign")))
    host = F.when(F.col("_foreign").isNull(), F.col("_u.host")).otherwise(F.col("_ascii"))
    good = F.col("_bad").isNull() & host.isNotNull()
    added = {into: F.when(good, _serialize(F.col("_u"), False, host))}
    if error:
        added[error] = F.when(~good, F.coalesce("_bad", F.lit("INVALID_URL")))
    if domain:
        added[domain] = F.when(good, host)
    return staged.withColumns(added).drop("_u", "_bad", "_foreign", "_ascii")


def url_domain(url: Column) -> Column:
    return let(_parse_strict(url), lambda u: F.when(_usable(u), u["host"]))


# --- resolving links ----------------------------------------------------------------

_ENTITIES = (
    ("(?i)&amp;", "&"),
    ("(?i)&quot;", '"'),
    ("&#39;", "'"),
    ("(?i)&lt;", "<"),
    ("(?i)&gt;", ">"),
)


def base_url(url: Column) -> Column:
    """Parsed form of a page address, to resolve many links against."""
    return _parse(url)


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute form of a link on the page with the given base_url(); null unless http(s)."""
    link = js_trim(href)
    for pattern, plain in _ENTITIES:
        link = F.regexp_replace(link, pattern, plain)
    link = F.regexp_replace(F.regexp_replace(link, r"[\t\r\n]", ""), r"^\\+", "/")
    folder = F.regexp_replace(F.regexp_replace(base["path"], r"[^/]*$", ""), "^/?", "/")
    page = F.concat(_origin(base), base["path"])

    def join(h: Column) -> Column:
        return (
            F.when(h.rlike(_SCHEME), h)
            .when(h.startswith("//"), F.concat(base["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(_origin(base), h))
            .when(h.startswith("?"), F.concat(page, h))
            .when(h.startswith("#") | (h == ""), F.concat(page, base["query"], h))
            .otherwise(F.concat(_origin(base), folder, h))
        )

    resolved = let(
        _parse(let(link, join)),
        lambda u: F.when(_usable(u), _serialize(u, fragment=True)),
    )
    return F.when(F.coalesce(href, F.lit("")) != "", resolved)


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a link against an absolute URL; null unless the result is http(s)."""
    return let(base_url(base), lambda b: resolve_link(href, b))


def decode_url_candidate(value: Column) -> Column:
    """Percent-decode up to twice; stop where decoding would fail."""
    bad = F.lit(chr(0xFFFD))

    def once(c: Column) -> Column:
        def keep_or_take(decoded: Column) -> Column:
            broken = F.contains(decoded, bad) & ~F.contains(c, bad)
            return F.when(F.coalesce(broken, F.lit(True)), c).otherwise(decoded)

        return let(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), keep_or_take)

    return let(let(js_trim(value), once), once)


# --- pagination -----------------------------------------------------------------------


def strip_pagination_marker(path: Column) -> Column:
    c = F.regexp_replace(path, K.PATH_MARKER_BEFORE_EXTENSION, "$2")
    c = F.regexp_replace(c, K.PATH_MARKER_WORD, "")
    c = F.regexp_replace(c, K.PATH_MARKER_NUMBER, "")
    return F.regexp_replace(c, "/$", "")


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _pairs(query: Column) -> Column:
    """array<struct<key, value>> of decoded query parameters."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pairs,
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("key"),
            F.when(
                F.contains(p, F.lit("=")),
                _form_decode(F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p))),
            )
            .otherwise("")
            .alias("value"),
        ),
    )


def _is_paging(pair: Column) -> Column:
    return F.lower(pair["key"]).isin(*K.PAGING_KEYS)


def pagination_series_key(url: Column) -> Column:
    """Equal for all pages of one paginated article; null for an unusable URL."""

    def key(u: Column) -> Column:
        encoded = F.transform(
            F.filter(_pairs(_query(u)), lambda p: ~_is_paging(p)),
            lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])),
        )
        query = F.array_join(F.array_sort(encoded), "&")
        return F.when(
            _usable(u),
            F.concat(
                _origin(u),
                strip_pagination_marker(_path(u["path"])),
                let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")),
            ),
        )

    return let(_parse(url), key)


def pagination_page_number(url: Column, link_text: Column | None = None) -> Column:
    """Page number from the link text, else a paging parameter, else the path."""

    def number(u: Column) -> Column:
        numbered = F.filter(
            _pairs(_query(u)), lambda p: _is_paging(p) & p["value"].rlike(r"^\d{1,3}$")
        )
        from_path = let(
            _path(u["path"]),
            lambda path: F.coalesce(
                non_empty(F.regexp_extract(path, K.PATH_MARKER_BEFORE_EXTENSION, 1)),
                non_empty(F.regexp_extract(path, K.PATH_MARKER_WORD, 1)),
                non_empty(F.regexp_extract(path, K.PATH_MARKER_NUMBER, 1)),
            ),
        )
        return F.when(_usable(u), F.coalesce(F.get(numbered, 0)["value"], from_path))

    candidates = [let(_parse(url), number)]
    if link_text is not None:
        candidates.insert(0, non_empty(F.regexp_extract(js_trim(link_text), r"^(\d{1,3})$", 1)))
    return F.coalesce(*candidates).try_cast("bigint")


def is_next_link(text: Column, rel: Column) -> Column:
    tokens = F.split(F.lower(F.coalesce(rel, F.lit(""))), r"\s+")
    return F.array_contains(tokens, "next") | text.rlike(K.NEXT_TEXT)


# --- images ---------------------------------------------------------------------------


def is_image_url(url: Column) -> Column:
    return let(_parse(url), lambda u: _usable(u) & u["path"].rlike(K.IMAGE_PATH))


def is_placeholder_image(url: Column) -> Column:
    blank = let(
        _parse(url),
        lambda u: _usable(u) & F.lower(_path(u["path"])).rlike(K.PLACEHOLDER_PATH),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(True)).otherwise(blank)


def best_srcset(value: Column) -> Column:
    """Best candidate of a srcset: highest width or density; the last one wins ties."""
    candidates = F.transform(
        F.split(value, ","),
        lambda c, i: F.struct(
            F.split(collapse_space(c), " ").alias("words"), i.alias("position")
        ),
    )
    scored = F.transform(
        F.filter(candidates, lambda c: F.get(c["words"], F.lit(0)) != ""),
        lambda c: F.struct(
            F.coalesce(
                non_empty(F.regexp_extract(F.get(c["words"], 1), r"(?i)^(\d+(?:\.\d+)?)w$", 1)).cast("double"),
                non_empty(F.regexp_extract(F.get(c["words"], 1), r"(?i)^(\d+(?:\.\d+)?)x$", 1)).cast("double")
                * 10_000,
                c["position"].cast("double"),
            ).alias("score"),
            c["position"].alias("position"),
            F.get(c["words"], 0).alias("url"),
        ),
    )
    return F.array_max(scored)["url"]


# Addresses that came out of resolve_link() are in normal form: a short pattern splits them.


def resolved_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def resolved_is_placeholder(url: Column) -> Column:
    return url.isNull() | F.lower(resolved_path(url)).rlike(K.PLACEHOLDER_PATH)


_WEB_IMAGE = r"(?i)^https?:/*[^/?#\s]+/[^?#]*\.(?:avif|gif|jpe?g|png|webp)(?:[?#]|$)"


def original_from_viewer(url: Column) -> Column:
    """Image behind a resolved link: the link itself, or the image a viewer page shows."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    candidates = F.concat(F.array(query), F.transform(_pairs(query), lambda p: p["value"]))
    images = F.filter(
        F.transform(candidates, decode_url_candidate), lambda c: c.rlike(_WEB_IMAGE)
    )
    shown = let(_parse(F.get(images, 0)), lambda i: F.when(_usable(i), _serialize(i, True)))
    path = resolved_path(url)
    return F.when(path.rlike(K.IMAGE_PATH), url).when(path.rlike(K.IMAGE_VIEWER_PATH), shown)
