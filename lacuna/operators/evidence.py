"""Evidence around signals: contracts as violation tables, retention sets, admission, review logs, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.plans import policy

from .selection import top


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, rule: a row for each rule that a row breaks (a null condition counts as broken).

    The flags are exploded with their names and filtered afterwards: where an array of names alone is exploded, Spark 4.1
    prunes the fields of structs that the rules read, and `collect` and `count` disagree.
    """
    flags = F.array(*(F.struct(F.lit(name).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok")) for name, ok in rules.items()))
    return df.select(*keys, F.explode(flags).alias("_flag")).where("not _flag.ok").select(*keys, "_flag.rule")


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def matched_index(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule: rows of either side without exactly one partner."""
    a, b = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "n_left"), (right, "n_right")))
    both = a.join(b, keys, "full_outer")
    rule = F.when(F.col("n_left").isNull(), "not_published").when(F.col("n_right").isNull(), "not_described").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
    return both.select(*keys, rule.alias("rule")).where("rule is not null")


def retention(df: DataFrame, assets: str, removed: str, permanent: list[str]) -> DataFrame:
    """retained, newly_removed and removed_total of arrays of asset keys."""
    keep = F.array(*(F.lit(k) for k in permanent))
    gone = F.array_except(assets, keep)
    return df.withColumn("retained", F.array_sort(F.array_intersect(assets, keep))).withColumn("newly_removed", F.array_sort(gone)).withColumn("removed_total", F.array_sort(F.array_union(removed, gone)))


def availability(assets: Column, removed: Column, key: str, applicable: Column) -> Column:
    return F.when(~applicable, "not_applicable").when(F.array_contains(assets, key), "recorded").when(F.array_contains(removed, key), "unavailable_historical").otherwise("not_recorded")


def listed(runs: DataFrame, by: list[str], at: str, ident: str) -> DataFrame:
    """runs with `place`: the newest of an owner first, then by id; a list of all is a sort by the same keys."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), ident)).cast("long"))


def reservation(size: Column) -> Column:
    return F.greatest(F.lit(policy.GIB), F.ceil(size * policy.RESERVE_FACTOR))


def admitted(runs: DataFrame, by: list[str], capacity: Column, order: list[Column], active: Column) -> DataFrame:
    """runs with reserved, in_use (what earlier active runs hold) and admitted."""
    held = runs.withColumn("reserved", F.when(active, reservation(F.col("size_bytes"))).otherwise(F.lit(0)).cast("long"))
    before = F.coalesce(F.sum("reserved").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("in_use", before).withColumn("admitted", capacity >= policy.MIN_FREE + F.col("in_use") + reservation(F.col("size_bytes")))


def latest(events: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key and event_count; append-only logs keep everything, this is their summary."""
    counted = events.withColumn("event_count", F.count("*").over(Window.partitionBy(*by)))
    return top(counted, by, order)


def review_status(decision: Column, prior: Column) -> Column:
    return F.when(decision == "accepted", "completed").when(decision == "rejected", F.coalesce(prior, F.lit("needs_review")))


def verified(files: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """manifest with a state: verified, missing, size_mismatch or hash_mismatch; files has key, size_bytes, sha256."""
    have = files.select(*key, F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    state = F.when(F.col("_sha").isNull(), "missing").when(F.col("_size") != F.col("size_bytes"), "size_mismatch").when(F.col("_sha") != F.col("sha256"), "hash_mismatch").otherwise("verified")
    return manifest.join(have, key, "left").withColumn("state", state).drop("_size", "_sha")


def lease_state(age_s: Column, alive: Column, same_host: Column, stale_s: float) -> Column:
    """free, held or stale of a claim."""
    return F.when(age_s.isNull(), "free").when(same_host & ~alive, "stale").when(age_s >= stale_s, "stale").otherwise("held")


def outcome(status: Column, published: Column, reviewed: Column) -> Column:
    return F.struct(F.when(status == "failed", "failed").when(status == "running", "pending").otherwise("finished").alias("processing"), F.when(published, "published").otherwise("withheld").alias("publication"), F.when(reviewed, "reviewed").otherwise("unreviewed").alias("review"))
