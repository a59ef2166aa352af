"""URL filter: dated list entries and an as-of join, in DataFrame functions only.

A list is a log of dated changes: an entry (a host, a parent domain, or a host with a path prefix) is put on it with an
action, changed or taken off. Changes of an entry become validity intervals; a capture is judged by the entries that
were valid when it was fetched: the most specific matching entry decides. Entries and captures meet by an equi-join on
(entry, month), so that an entry with a long history and a hot host are both spread; intervals are cut to the months
that have captures. Captures are judged once per distinct (url, time) and joined back, so repeated rows stay.

Defined cases: a null or malformed url has no keys and gets no action, as does a null time; an entry with a null key or
date is ignored; of several changes of an entry at one instant the action that sorts last holds; intervals include
their start and exclude their end; result columns replace columns of the same name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REMOVED = "remove"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, with its leading slash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Entries that would match the url: the host and its parent domains, and the host with each path prefix."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(
        labels, k, F.greatest(F.size(labels) - k + 1, F.lit(0))), "."))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(
        host_of(url), F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(
        F.array().cast("array<string>"))


def month_of(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def intervals(changes: DataFrame, key: str = "entry", time: str = "changed_at", action: str = "action") -> DataFrame:
    """Validity intervals (entry, action, valid_from, valid_to; the last one is open) of a change log."""
    one = (changes.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
           .groupBy(F.col(key).alias("entry"), F.col(time).alias("valid_from")).agg(F.max(action).alias("action")))
    after = Window.partitionBy("entry").orderBy("valid_from")
    return one.withColumn("valid_to", F.lead("valid_from").over(after)).filter(F.col("action") != REMOVED)


def judge(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Add ``action``, ``entry`` and ``valid_from`` of the deciding entry (null: none) to every capture."""
    distinct = captures.select(F.col(url_col).alias("_url"), F.col(time_col).alias("_at")).filter(
        F.col("_url").isNotNull() & F.col("_at").isNotNull()).distinct()
    span = distinct.agg(F.struct(F.min("_at").alias("lo"), F.max("_at").alias("hi"))).scalar()
    keyed = distinct.select("_url", "_at", month_of(F.col("_at")).alias("_month"),
                            F.explode(keys_of(F.col("_url"))).alias("_key"))
    valid = intervals(changes).withColumn("_span", span).select(
        "entry", "action", "valid_from", "valid_to", month_of(F.greatest("valid_from", "_span.lo")).alias("_from"),
        month_of(F.least("valid_to", "_span.hi")).alias("_to"))
    valid = valid.filter(F.col("_from") <= F.col("_to")).select(
        "entry", "action", "valid_from", "valid_to", F.explode(F.sequence("_from", "_to")).alias("_m"))
    hits = keyed.join(valid, (F.col("_key") == F.col("entry")) & (F.col("_month") == F.col("_m"))
                      & (F.col("_at") >= F.col("valid_from"))
                      & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    verdicts = hits.groupBy("_url", "_at").agg(F.max(F.struct(
        F.length("entry").alias("n"), "entry", "action", "valid_from")).alias("_v"))
    plain = captures.drop("action", "entry", "valid_from")
    return (plain.join(verdicts, (F.col(url_col) == F.col("_url")) & (F.col(time_col) == F.col("_at")), "left")
            .select(*[plain[c] for c in plain.columns], F.col("_v.action").alias("action"),
                    F.col("_v.entry").alias("entry"), F.col("_v.valid_from").alias("valid_from")))
