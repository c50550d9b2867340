"""Address checks against block lists, host verdicts and redirect chains."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import net as N
from folioscope.functions import urls as U
from folioscope.session import ensure_checkpoint_dir

def block_list(spark: SparkSession) -> DataFrame:
    """The fixed networks as a table; literal rows, so that the planner knows their size."""
    rows = ", ".join(f"('{n}', {p})" for n, p in (*K.BLOCKED_IPV4, *K.BLOCKED_IPV6))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(network, prefix)")


def cidr_join(addresses: DataFrame, cidrs: DataFrame) -> DataFrame:
    """Pairs of an address and each network containing it: (address, network, prefix).

    A range condition would compare every address with every network. Instead an address
    is cut to each prefix length that occurs (at most 33 + 129) and matched by equality.
    """
    networks = cidrs.withColumn("_bits", N.address_bits(F.col("network"))).select(
        "network",
        "prefix",
        F.length("_bits").alias("_width"),
        F.concat(
            F.length("_bits").cast("string"),
            F.lit(":"),
            F.expr("substring(_bits, 1, prefix)"),
        ).alias("_key"),
    )
    lengths = networks.select("_width", F.col("prefix").alias("_length")).distinct()
    cut = (
        addresses.select("address")
        .distinct()
        .withColumn("_bits", N.address_bits(N.bare_address(F.col("address"))))
        .withColumn("_width", F.length("_bits"))
        .join(F.broadcast(lengths), "_width")
        .select(
            "address",
            F.concat(
                F.col("_width").cast("string"), F.lit(":"), F.expr("substring(_bits, 1, _length)")
            ).alias("_key"),
        )
    )
    hits = cut.join(networks.drop("_width"), "_key")
    return hits.select("address", "network", "prefix")


def _by_host(answers: DataFrame, prefix: str) -> DataFrame:
    """One row per host: number of distinct addresses, all fake, any blocked."""
    distinct = answers.select("host", "address").distinct()
    return distinct.groupBy("host").agg(
        F.count("*").alias(f"{prefix}n"),
        F.bool_and(N.fake_ip(F.col("address"))).alias(f"{prefix}fake"),
        F.bool_or(N.blocked_ip(F.col("address"))).alias(f"{prefix}blocked"),
    )


def host_verdict(hosts: DataFrame, dns: DataFrame, trusted: DataFrame) -> DataFrame:
    """(host, error_code, source): may this host be fetched, and by which answers?

    dns and trusted: host, address. Where a host gets only stand-in addresses of a proxy,
    the trusted answers decide. source is 'literal', 'dns', 'trusted' or null.
    """
    literal = F.regexp_replace(F.col("host"), r"^\[|\]$", "")
    is_literal = N.address_bits(literal).isNotNull()
    judged = (
        hosts.select("host")
        .distinct()
        .join(_by_host(dns, "d_"), "host", "left")
        .join(_by_host(trusted, "t_"), "host", "left")
        .withColumn("_literal", is_literal)
    )
    fake = F.coalesce("d_fake", F.lit(False))
    error = (
        F.when(N.blocked_host(F.col("host")), "PRIVATE_NETWORK_BLOCKED")
        .when(
            F.col("_literal"), F.when(N.blocked_ip(literal), "PRIVATE_NETWORK_BLOCKED")
        )
        .when(F.col("d_n").isNull(), "DNS_FAILED")
        .when(fake & F.col("t_n").isNull(), "DNS_FAILED")
        .when(F.when(fake, F.col("t_blocked")).otherwise(F.col("d_blocked")), "PRIVATE_NETWORK_BLOCKED")
    )
    return judged.withColumn("error_code", error).select(
        "host",
        "error_code",
        F.when(F.col("error_code").isNull(), F.when(F.col("_literal"), "literal")
               .when(fake, "trusted").otherwise("dns")).alias("source"),
    )


def safe_addresses(verdicts: DataFrame, dns: DataFrame, trusted: DataFrame) -> DataFrame:
    """Distinct (host, family, address) that may be connected to."""
    literal = F.regexp_replace(F.col("host"), r"^\[|\]$", "")
    answers = (
        dns.select("host", "address", F.lit("dns").alias("source"))
        .unionByName(trusted.select("host", "address", F.lit("trusted").alias("source")))
        .distinct()
    )
    listed = answers.join(verdicts.select("host", "source"), ["host", "source"], "left_semi")
    literals = verdicts.where(F.col("source") == "literal").select(
        "host", literal.alias("address"), "source"
    )
    return listed.unionByName(literals).select(
        "host", N.address_family(F.col("address")).alias("family"), "address"
    )


def hop_error(url: Column) -> Column:
    """Why a redirect target may not be followed; null when it may."""
    host = U.url_domain(url)
    literal = F.regexp_replace(host, r"^\[|\]$", "")
    private = N.blocked_host(host) | (
        N.address_bits(literal).isNotNull() & N.blocked_ip(literal)
    )
    return F.coalesce(
        U.url_error(url),
        F.when(F.coalesce(private, F.lit(False)), F.lit("PRIVATE_NETWORK_BLOCKED")),
    )


def resolve_redirects(fetch_log: DataFrame, max_hops: int = K.MAX_REDIRECTS) -> DataFrame:
    """Follow Location headers: (url, final_url, hops, status, error_code).

    fetch_log: url (unique), status, location. The next address and its check are worked
    out once per log row. Only rows that still move are joined, at most `max_hops` times;
    each round ends in a reliable checkpoint. Many chains may meet in one address, so the
    joins allow for skew.
    """
    ensure_checkpoint_dir(fetch_log.sparkSession)
    redirected = F.col("status").between(300, 399)
    hop = fetch_log.select(
        "url",
        "status",
        F.when(redirected, U.absolute_url(F.col("location"), F.col("url"))).alias("target"),
        (redirected & F.col("location").isNotNull()).alias("moves"),
        "location",
    )
    # A target that is no web address is judged by the header as it was sent.
    refused = F.when(F.col("target").isNull(), U.url_error(F.col("location"))).otherwise(
        hop_error(F.col("target"))
    )
    # Targets are compared without their fragment, as requests are made without it.
    hop = hop.select(
        "url",
        "status",
        F.regexp_replace("target", "#.*$", "").alias("target"),
        "moves",
        F.when(F.col("moves"), refused).alias("error_code"),
    ).checkpoint()
    step = hop.select(F.col("url").alias("target"), *[F.col(c).alias(f"_{c}") for c in hop.columns])
    goes_on = F.col("moves") & F.col("error_code").isNull()
    state = hop.withColumn("final_url", F.col("url")).withColumn("hops", F.lit(0))
    settled, moving = state.where(~goes_on), state.where(goes_on)
    for _ in range(max_hops):
        arrived = (
            moving.select("url", "target", "hops").join(step, "target", "left")
            .select(
                "url",
                F.col("_status").alias("status"),
                F.col("_target").alias("target"),
                F.coalesce("_moves", F.lit(False)).alias("moves"),
                F.when(F.col("_url").isNull(), "UNKNOWN_ERROR")
                .otherwise(F.col("_error_code"))
                .alias("error_code"),
                F.col("target").alias("final_url"),
                (F.col("hops") + 1).alias("hops"),
            )
            .checkpoint()
        )
        settled = settled.unionByName(arrived.where(~goes_on))
        moving = arrived.where(goes_on)
        if moving.isEmpty():
            break
    no_location = F.col("status").between(300, 399) & ~F.col("moves")
    return settled.unionByName(moving).select(
        "url",
        "final_url",
        "hops",
        "status",
        F.coalesce(
            "error_code",
            F.when(F.col("moves"), "TOO_MANY_REDIRECTS").when(no_location, "HTTP_SERVER_ERROR"),
        ).alias("error_code"),
    )
