"""URL filters with a memory: dated list entries as validity intervals.

An entry adds a rule to a list or takes it off at an instant. Between an
addition and the next event of the same rule it is active. Every capture is
judged by the entries that were active when it was fetched: the most specific
rule decides, and among equally specific ones an allowing rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_filter, maybe_in

#: Seconds of a slice of time. Rule and slice together are the join key, so a
#: rule with a long history or very many captures is spread over many tasks.
SLICE = 90 * 86_400


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$|\.(?=:[0-9]*$|$)", ""))


def suffixes(host: Column, most: int | None = None) -> Column:
    """The host and its parent domains, the whole host first; only those of up to ``most`` labels if given."""
    parts = F.split(host, r"\.")
    upto = F.size(parts) if most is None else F.least(F.size(parts), F.lit(most))
    return F.transform(F.sequence(upto, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, -n, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, allow, valid_from, valid_to) from dated entries (rule, allow, action, at).

    action: 'add' or 'remove'. Rules are lower-cased domains. Of events of one
    rule and kind at one instant the removal wins; a second addition while
    active changes nothing; a removal of what isn't active is ignored. valid_to is exclusive, null where the rule is still active."""
    clean = entries.where("rule is not null and at is not null and action in ('add', 'remove')").select(F.lower("rule").alias("rule"), F.coalesce("allow", F.lit(False)).alias("allow"), "at", (F.col("action") == "add").alias("adds"))
    events = clean.groupBy("rule", "allow", "at").agg(F.bool_and("adds").alias("adds"))
    history = Window.partitionBy("rule", "allow").orderBy("at")
    changes = events.withColumn("was", F.coalesce(F.lag("adds").over(history), F.lit(False))).where("adds <> was")
    return changes.withColumn("valid_to", F.lead("at").over(history)).where("adds").select("rule", "allow", F.col("at").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at", slice_seconds: int = SLICE) -> DataFrame:
    """One row per row of ``captures``: id, url, host, fetched_at, rule (that decided), active_since, n_active (matching active rules), kept.

    A rule matches its domain and all below, of any number of labels. Captures without a matching active
    rule, with a null or hostless URL or with a null time are kept; so are all if
    the list is empty, and no captures give no rows. Repeated captures are judged once and returned each. Null ids are kept;
    other columns are not looked at. Distinct (host, time) pairs are
    joined, not captures, so that popular hosts weigh no more than others."""
    seconds = lambda c: F.unix_seconds(c)
    own = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(at_col).cast("timestamp").alias("fetched_at"))
    moments = own.where("host <> '' and fetched_at is not null").select("host", "fetched_at").distinct()
    active = intervals(entries)
    # no rule of the list has more labels, so longer parents of a host would meet nothing
    most = active.agg(F.max(F.size(F.split("rule", r"\."))).alias("labels")).first()["labels"] or 1
    probes = moments.select("host", "fetched_at", F.explode(suffixes(F.col("host"), most)).alias("rule"), F.floor(seconds(F.col("fetched_at")) / slice_seconds).alias("slice"))
    # parent domains that no rule names, such as top-level ones, stay out of the shuffle but for a few that a bitmap lets through
    listed = key_filter(active.select(F.col("rule").alias("k")).distinct())
    probes = probes.withColumnRenamed("rule", "k").where(maybe_in(listed)).withColumnRenamed("k", "rule")

    span = moments.agg(F.min("fetched_at").alias("low"), F.max("fetched_at").alias("high")).first()
    if span["low"] is None:
        span = {"low": None, "high": None}
    low, high = (F.lit(span[k]).cast("timestamp") for k in ("low", "high"))
    # only the slices in which something was fetched
    clipped = active.where((F.col("valid_from") <= high) & (F.col("valid_to").isNull() | (F.col("valid_to") > low)))
    first = F.floor(seconds(F.greatest(F.col("valid_from"), low)) / slice_seconds)
    last = F.floor(seconds(F.least(F.coalesce(F.col("valid_to"), high), high)) / slice_seconds)
    sliced = clipped.select(F.col("rule").alias("of"), "allow", "valid_from", "valid_to", F.explode(F.sequence(first, last)).alias("in_slice"))

    on = (F.col("rule") == F.col("of")) & (F.col("slice") == F.col("in_slice")) & (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    met = probes.join(sliced, on)
    strength = F.struct(F.length("rule").alias("size"), F.col("allow").alias("allow"), F.col("rule").alias("rule"), F.col("valid_from").alias("since"))
    verdicts = met.groupBy("host", "fetched_at").agg(F.max(strength).alias("best"), F.count("*").alias("n_active"))
    verdicts = verdicts.select(F.col("host").alias("h"), F.col("fetched_at").alias("t"), "best", "n_active")
    judged = own.join(verdicts, (F.col("host") == F.col("h")) & (F.col("fetched_at") == F.col("t")), "left")
    return judged.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", F.col("fetched_at").alias(at_col), F.col("best.rule").alias("rule"), F.col("best.since").alias("active_since"),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), F.coalesce(F.col("best.allow"), F.lit(True)).alias("kept"),
    )
