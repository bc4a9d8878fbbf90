"""URL filters: dated list entries as validity intervals, joined to captures as of their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import stored

ACTIONS = ("block", "allow")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of list entries (pattern, action, listed_on).

    ``action`` is ``block``, ``allow`` or anything else for a removal. An entry holds from
    its day to the day of the next entry of its pattern, exclusive; the last one holds on.
    Of several entries of a pattern on one day the first of block, allow, removal counts.
    Returns one row per pattern with ``spans``, its intervals in order of time: equal days
    are merged before the shuffle, so there are at most as many as days. Rows with null
    pattern or day are left out.
    """
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    days = (
        entries.where("pattern is not null and listed_on is not null")
        .groupBy("pattern", "listed_on")
        .agg(F.min(rank).alias("rank"))
    )
    until = F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on"))
    spans = days.withColumn("until", until).where("rank < 2")
    one = F.struct(
        F.col("listed_on").alias("since"),
        "until",
        F.when(F.col("rank") == 0, ACTIONS[0]).otherwise(ACTIONS[1]).alias("action"),
    )
    return spans.groupBy("pattern").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading www."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def patterns_of(url: Column) -> Column:
    """Every pattern that can match a URL, most telling first: the host with the first part
    of its path, then the host, then each parent domain of two labels at least."""
    host = host_of(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    with_path = F.when(path != "", F.array(F.concat(host, F.lit("/"), path)))
    return F.when(
        host.isNotNull(), F.concat(F.coalesce(with_path, F.array().cast("array<string>")), parents)
    )


def apply_lists(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict for each capture (page_id, url, fetched_on) by the entries active that day.

    Each capture asks for a handful of patterns. They are joined with the patterns' spans,
    one row per pattern and written before, so a host with a third of all captures can be split; the active
    span is then looked up in the row. The most telling pattern with an active span
    decides. Returned are the captures with ``host``, ``verdict`` (block, allow or none),
    ``pattern`` and ``since`` of the entry that decided. A null or unreadable URL or a
    null day matches nothing, repeated captures each get a row, and without entries all
    verdicts are none. Other columns are ignored.
    """
    asked = captures.select(
        "page_id", "url", "fetched_on", F.monotonically_increasing_id().alias("capture")
    ).select("*", F.posexplode_outer(patterns_of(F.col("url"))).alias("place", "pattern"))
    known = asked.join(stored(intervals(entries)), "pattern", "left")
    active = F.filter(
        "spans",
        lambda s: (s["since"] <= F.col("fetched_on"))
        & (s["until"].isNull() | (F.col("fetched_on") < s["until"])),
    )
    decided = F.when(
        F.size(F.coalesce(active, F.array())) > 0,
        F.struct(
            "place", "pattern", F.get(active, F.lit(0))["since"].alias("since"),
            F.get(active, F.lit(0))["action"].alias("action"),
        ),
    )
    best = (
        known.select("page_id", "url", "fetched_on", "capture", decided.alias("by"))
        .groupBy("capture", "page_id", "url", "fetched_on")
        .agg(F.min("by").alias("by"))
    )
    return best.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        "fetched_on",
        F.coalesce("by.action", F.lit("none")).alias("verdict"),
        F.col("by.pattern").alias("pattern"),
        F.col("by.since").alias("since"),
    )
