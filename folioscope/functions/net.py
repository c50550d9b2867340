"""Network-safety, fetch-outcome and content-type column expressions."""

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions.text import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)"
_IPV6_SHAPE = (
    r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?"
    r"(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"
)
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def bare_address(address: Column) -> Column:
    """Without brackets and zone id."""
    return F.substring_index(F.regexp_replace(address, r"^\[|\]$", ""), "%", 1)


def is_ipv4(address: Column) -> Column:
    return address.rlike(IPV4)


def ipv4_number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    value = F.aggregate(
        parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.cast("bigint")
    )
    return F.when(is_ipv4(address), value)


def ipv6_hex(address: Column) -> Column:
    """32 hex digits of an IPv6 address; null when it is not one."""
    number = ipv4_number(F.regexp_extract(address, r":([0-9.]+)$", 1))
    embedded = let(
        number,
        lambda n: F.concat(
            F.regexp_replace(address, r"[0-9.]+$", ""),
            F.lower(F.hex(F.shiftright(n, 16))),
            F.lit(":"),
            F.lower(F.hex(n.bitwiseAND(F.lit(65535)))),
        ),
    )
    plain = F.lower(F.when(F.contains(address, F.lit(".")), embedded).otherwise(address))

    def halves(text: Column) -> Column:
        sides = F.split(text, "::")
        side = lambda i: F.filter(
            F.split(F.coalesce(F.get(sides, i), F.lit("")), ":"), lambda g: g != ""
        )
        return F.struct(
            text.alias("text"),
            F.size(sides).alias("sides"),
            side(0).alias("left"),
            side(1).alias("right"),
        )

    def join(h: Column) -> Column:
        missing = 8 - F.size(h["left"]) - F.size(h["right"])
        groups = F.concat(h["left"], F.array_repeat(F.lit("0"), missing), h["right"])
        well_formed = (
            h["text"].rlike(_IPV6_SHAPE)
            & F.contains(h["text"], F.lit(":"))
            & F.when(h["sides"] == 2, missing >= 1).otherwise(missing == 0)
        )
        return F.when(
            well_formed, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
        )

    return let(let(plain, halves), join)


def address_family(address: Column) -> Column:
    return F.when(is_ipv4(address), 4).when(ipv6_hex(address).isNotNull(), 6)


def address_bits(address: Column) -> Column:
    """The address as a string of 32 or 128 binary digits; null for anything else."""
    v6 = let(
        ipv6_hex(address),
        lambda hexed: F.concat(
            *[F.lpad(F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 2), 32, "0") for i in range(4)]
        ),
    )
    v4 = F.lpad(F.bin(ipv4_number(address)), 32, "0")
    return F.when(is_ipv4(address), v4).otherwise(v6)


def network_bits(network: str, prefix: int) -> str:
    address = ipaddress.ip_address(network)
    return f"{int(address):0{address.max_prefixlen}b}"[:prefix]


def _in_ranges(bits: Column, blocks) -> Column:
    test = F.lit(False)
    for network, prefix in blocks:
        test = test | bits.startswith(network_bits(network, prefix))
    return test


def blocked_ip(address: Column) -> Column:
    """True for private and special addresses, and for anything that is no address."""
    bits = let(bare_address(address), address_bits)
    blocked = let(
        bits,
        lambda b: F.when(F.length(b) == 32, _in_ranges(b, K.BLOCKED_IPV4)).otherwise(
            _in_ranges(b, K.BLOCKED_IPV6)
        ),
    )
    return F.coalesce(blocked, F.lit(True))


def fake_ip(address: Column) -> Column:
    """True for the range that proxies answer with instead of the real address."""
    network = ipaddress.ip_network(f"{K.FAKE_IPV4[0]}/{K.FAKE_IPV4[1]}")
    number = let(bare_address(address), ipv4_number)
    return F.coalesce(
        number.between(int(network[0]), int(network[-1])), F.lit(False)
    )


def blocked_host(host: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(host), r"^\[|\]$", ""), r"\.$", "")

    def listed(n: Column) -> Column:
        test = n.isin(*K.BLOCKED_HOSTS)
        for suffix in K.BLOCKED_HOST_SUFFIXES:
            test = test | n.endswith(suffix)
        return test

    return let(name, listed)


def content_type_ok(content_type: Column, kind: str) -> Column:
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    if kind == "html":
        html, xhtml = K.HTML_CONTENT_TYPES
        return F.contains(lowered, F.lit(html)) | F.contains(lowered, F.lit(xhtml))
    if kind == "image":
        return F.trim(F.substring_index(lowered, ";", 1)).isin(*K.IMAGE_CONTENT_TYPES)
    raise ValueError(f"unknown kind {kind!r}")


def fetch_outcome(
    status: Column,
    content_type: Column,
    body_bytes: Column,
    hops: Column,
    location: Column,
    timed_out: Column,
    max_bytes: int | None = None,
    max_redirects: int = K.MAX_REDIRECTS,
) -> Column:
    """Null for a usable HTML response, else its error code; no status at all is an error."""
    redirected = status.between(300, 399)
    has_location = F.coalesce(location, F.lit("")) != ""
    return (
        F.when(timed_out, "REQUEST_TIMEOUT")
        .when(status.isNull(), "UNKNOWN_ERROR")
        .when(redirected & has_location & (hops >= max_redirects), "TOO_MANY_REDIRECTS")
        .when(status.isin(401, 403), "HTTP_FORBIDDEN")
        .when(status.isin(404, 410), "HTTP_NOT_FOUND")
        .when(~status.between(200, 299), "HTTP_SERVER_ERROR")
        .when(~content_type_ok(content_type, "html"), "UNSUPPORTED_CONTENT_TYPE")
        .when(F.lit(False) if max_bytes is None else body_bytes > max_bytes, "CONTENT_TOO_LARGE")
        .when(F.coalesce(body_bytes, F.lit(0)) == 0, "EMPTY_RESPONSE")
    )


def retry_eligible(value: Column, policy: str) -> Column:
    """Whether a failed attempt is worth another one.

    policy: "http" (status code), "image" or "client" (error codes).
    """
    values = {
        "http": K.ALTERNATE_CLIENT_STATUSES,
        "image": K.RETRYABLE_IMAGE_CODES,
        "client": K.RETRYABLE_CLIENT_CODES,
    }[policy]
    return F.coalesce(value.isin(*values), F.lit(False))


def error_message(code: Column) -> Column:
    """Display text of an error code; null for unknown codes. 20 literals, no join."""
    table = F.create_map(*[F.lit(x) for pair in K.ERROR_MESSAGES.items() for x in pair])
    return F.try_element_at(table, code)


_HEAD = r"(?is)^((?:HTTP/\d+(?:\.\d+)?\s+100\b.*?\r?\n\r?\n)*)(.*?)(\r?\n\r?\n)"
_STATUS = r"(?i)^HTTP/\d+(?:\.\d+)?\s+(\d{3})\b"


def parse_http_dump(raw: Column) -> Column:
    """struct<status_code, headers, body, error_code> of a stored HTTP response."""

    def head(latin1: Column) -> Column:
        group = lambda i: F.regexp_extract(latin1, _HEAD, i)
        return F.struct(
            group(2).alias("block"),
            (F.length(group(1)) + F.length(group(2)) + F.length(group(3))).alias("offset"),
        )

    def fields(block: Column) -> Column:
        lines = F.split(block, r"\r?\n")
        named = F.transform(
            F.filter(
                F.slice(lines, F.lit(2), F.size(lines)),
                lambda line: F.instr(line, F.lit(":")) > 1,
            ),
            lambda line: F.struct(
                F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"),
                F.trim(F.substring(line, F.instr(line, F.lit(":")) + 1, F.length(line))).alias(
                    "value"
                ),
            ),
        )
        return F.filter(named, lambda f: f["key"] != "")

    def last_of_each(named: Column) -> Column:
        later = lambda i: F.slice(named, i + 2, F.size(named))
        return F.map_from_entries(
            F.filter(named, lambda f, i: ~F.exists(later(i), lambda g: g["key"] == f["key"]))
        )

    def read(h: Column) -> Column:
        status = F.regexp_extract(h["block"], _STATUS, 1)
        ok = (h["offset"] > 0) & (status != "")
        return F.struct(
            F.when(ok, status).cast("int").alias("status_code"),
            F.when(ok, let(fields(h["block"]), last_of_each)).alias("headers"),
            F.when(ok, F.substring(raw, h["offset"] + 1, F.octet_length(raw))).alias("body"),
            F.when(~ok, "EMPTY_RESPONSE").alias("error_code"),
        )

    return let(let(F.decode(raw, "ISO-8859-1"), head), read)
