"""Operator 3, URL filters: a temporal list join in DataFrame operations only.

Dated list entries become validity intervals, and an as-of join tests every capture against the entries that
were active when it was fetched. An entry is a domain, which matches its hosts and their subdomains, or a
host with leading path segments. The most specific active entry decides; a block beats an allow of the
same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from lumenfold.session import materialize

#: More intervals than this are not broadcast: the join then shuffles and salts.
BROADCAST_ROWS = 100_000
#: Copies of each interval in the salted join, among which the captures of a hot key are spread.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), r"\.$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, its empty segments left out, with a slash before each segment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/$", "")


def keys_of(url: Column) -> Column:
    """The keys under which an entry may match the URL, each once; empty for a null URL or one without host."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.split(path_of(url), "/")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(segments)), lambda i: i > 1),
        lambda i: F.concat(host_of(url), F.array_join(F.slice(segments, F.lit(1), i), "/")),
    )
    return F.when(host_of(url) != "", F.concat(domains, prefixes)).otherwise(F.expr("cast(array() as array<string>)"))


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals [since, until) of the entries in events (key, list, listed_at, action).

    action 'add' opens an interval that the next event of the same key and list ends; 'remove' opens none.
    Events of one moment: a remove comes before an add. Repeated events change nothing; a null key, moment or
    action is ignored. until is null while the entry stands.
    """
    named = events.select("key", "list", "listed_at", "action").where("key is not null and listed_at is not null and action in ('add', 'remove')")
    order = Window.partitionBy("key", "list").orderBy("listed_at", F.col("action").desc())
    return (
        named.distinct()
        .withColumn("until", F.lead("listed_at").over(order))
        .where("action = 'add' and (until is null or until > listed_at)")
        .select("key", "list", F.col("listed_at").alias("since"), "until")
    )


def filter_urls(captures: DataFrame, events: DataFrame, url: str = "url", fetched_at: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures with n_active (long), decided_by (string) and blocked (boolean).

    n_active counts the (key, list) entries active at fetch time that match; decided_by is the key of the
    longest; blocked tells whether that key is on a list other than 'allow'. A capture with null or hostless
    URL, or without fetch time, matches nothing: 0, null, false. Captures stay one for one with ties, repeats
    and other columns; input columns of these three names are replaced. Equal (url, time) are tested once.
    """
    # written, as it is counted first and then joined
    valid = materialize(intervals(events), "intervals")
    asked = captures.select(F.col(url).alias("__url"), F.col(fetched_at).alias("__at")).dropna().distinct()
    keyed = asked.select("__url", "__at", F.explode(keys_of(F.col("__url"))).alias("key"))
    if valid.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = keyed.join(F.broadcast(valid), "key")
    else:
        salted = valid.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.withColumn("__salt", F.pmod(F.xxhash64("__url", "__at"), F.lit(SALTS)).cast("int")).join(salted, ["key", "__salt"])
    active = met.where("since <= __at and (until is null or __at < until)")
    rank = F.struct(F.char_length("key"), (F.col("list") != "allow").cast("int"), F.col("key"))
    found = active.groupBy("__url", "__at").agg(F.count("*").alias("__n"), F.max(rank).alias("__best"))
    kept = captures.drop("n_active", "decided_by", "blocked")
    # captures without host or time match nothing; a hash of the row deals them out, as nulls would all go to one task
    hashable = [f.name for f in kept.schema if not isinstance(f.dataType, (MapType, VariantType))]
    matches = (host_of(F.col(url)) != "") & F.col(fetched_at).isNotNull()
    kept = kept.withColumn("__place", F.when(matches, F.lit(0).cast("long")).otherwise(F.xxhash64(*hashable)))
    found = found.withColumn("__place", F.lit(0).cast("long"))
    return (
        kept.join(found, (kept["__place"] == found["__place"]) & (kept[url] == found["__url"]) & (kept[fetched_at] == found["__at"]), "left")
        .drop("__place")
        .withColumn("n_active", F.coalesce("__n", F.lit(0).cast("long")))
        .withColumn("decided_by", F.col("__best")["key"])
        .withColumn("blocked", F.coalesce(F.col("__best")["col2"] == 1, F.lit(False)))
        .drop("__n", "__best", "__url", "__at")
    )
