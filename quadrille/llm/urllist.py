"""URL filters by a temporal list join.

A dated list (an entry is added, an entry is removed) becomes validity intervals, and an as-of join finds for every
capture the entries that were active when it was fetched. An entry is a domain, which covers its subdomains, or a
domain with the first segment of a path. Only distinct sites (host and first segment) meet the list, once for each
stretch of time in which they were fetched; captures then join their site's few intervals of that stretch, so that a
host with a third of all captures is one row on one side and, on the other, rows that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a stretch of time that intervals are cut into for the join.
STRETCH = 30 * 86_400
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host, without user, port or final dot; null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", ""), F.lit(""))


def segment_of(url: Column) -> Column:
    """First segment of the path, in lower case; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), SEGMENT, 1), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """events (entry, add boolean, at seconds) as (entry, since, until): since <= t < until, until null if still active.
    At one time an addition outdoes a removal; repeated events and null entries or times count for nothing."""
    at = events.where("entry is not null and at is not null and add is not null").groupBy("entry", "at").agg(F.max("add").alias("add"))
    w = Window.partitionBy("entry").orderBy("at")
    runs = at.withColumn("before", F.lag("add").over(w)).where(F.col("add") != F.coalesce("before", F.lit(False)))
    return runs.withColumn("until", F.lead("at").over(w)).where("add").select("entry", F.col("at").alias("since"), "until")


def keys_of(host: Column, segment: Column) -> Column:
    """The entries that could cover a site: the host, its parent domains of two labels or more, and each with the
    segment. An address (digits, colons) has no parents."""
    labels = F.split(host, r"\.")
    n = F.when(host.rlike(r"^([0-9.]+|\[.*\])$"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.size(labels) - 2))
    domains = F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.when(segment.isNull(), domains).otherwise(F.concat(domains, F.transform(domains, lambda d: F.concat(d, F.lit("/"), segment))))


def active_entries(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "at") -> DataFrame:
    """Returns (id, host, at, blocked, n_active, entry, since) for every capture: its host, fetch time (seconds),
    whether any entry was active then, how many, and the most specific of them (the longest, then the last by code
    point) with the beginning of its interval.

    Captures without a host or time match nothing. Repeated rows and ids each give a row; an empty list blocks nothing.
    Other columns are not read."""
    rows = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), segment_of(F.col(url_col)).alias("segment"), F.col(time_col).cast("long").alias("at"))
    rows = rows.withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("long"))
    found = rows.where("host is not null and at is not null")
    sites = found.groupBy("host", "segment", "stretch").agg(F.lit(1).alias("one")).select("host", "segment", "stretch", F.explode(keys_of(F.col("host"), F.col("segment"))).alias("entry"))
    ends = found.agg(F.min("stretch").alias("first"), F.max("stretch").alias("final")).first()
    first, final = (ends["first"] or 0, ends["final"] or 0) if ends else (0, 0)
    low = F.greatest(F.lit(first), F.floor(F.col("since") / STRETCH).cast("long"))
    high = F.least(F.lit(final), F.coalesce(F.floor((F.col("until") - 1) / STRETCH).cast("long"), F.lit(final)))
    cut = intervals(events).withColumns({"low": low, "high": high}).where("low <= high").select("entry", "since", "until", F.explode(F.sequence("low", "high")).alias("stretch"))
    span = F.struct(F.length("entry").alias("length"), F.col("entry"), F.col("since"), F.col("until"))
    lists = sites.join(cut, ["entry", "stretch"]).groupBy("host", "segment", "stretch").agg(F.collect_list(span).alias("spans"))
    joined = rows.alias("c").join(
        lists.alias("l"),
        (F.col("c.host") == F.col("l.host")) & F.col("c.segment").eqNullSafe(F.col("l.segment")) & (F.col("c.stretch") == F.col("l.stretch")),
        "left",
    )
    active = F.filter(F.col("l.spans"), lambda s: (s["since"] <= F.col("c.at")) & (s["until"].isNull() | (F.col("c.at") < s["until"])))
    out = joined.select("c.id", "c.host", "c.at", F.coalesce(F.size(active), F.lit(0)).alias("n"), F.array_max(active).alias("top"))
    return out.select("id", "host", "at", (F.col("n") > 0).alias("blocked"), F.greatest("n", F.lit(0)).cast("long").alias("n_active"), F.col("top.entry").alias("entry"), F.col("top.since").alias("since"))
