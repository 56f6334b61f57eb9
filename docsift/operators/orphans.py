"""References that lead nowhere: missing, deleted or late targets, with counts per table and month.

Both entry points split the references by how often their key occurs.  A key
that holds more than one part in ``HEAVY_PARTS`` of all references is heavy;
there are fewer than ``HEAVY_PARTS`` such keys whatever the size of the data,
so their targets are broadcast.  All other keys go through a shuffle join in
which no key is large.

Defined results: a null reference is no case; a record with a ``deleted_at`` is
no case; rows of one key count once, with their earliest ``loaded_at``; records
with a null key are ignored, for they can't be named; a null ``loaded_at`` on
either side never counts as late; empty tables give empty results, and an empty
target table makes every reference ``missing``.  Only the named columns are
read, so further columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HEAVY_PARTS of all references is heavy; this bounds the broadcast.
HEAVY_PARTS = 2000
LATE_HOURS = 24


@dataclass(frozen=True)
class Reference:
    """One foreign key: ``src.record_key`` rows name ``dst.dst_key`` in ``src.ref_key``."""

    src_name: str
    src: DataFrame
    record_key: str
    ref_key: str
    dst: DataFrame
    dst_key: str


def _records(r: Reference) -> DataFrame:
    """Live records with a reference: record_id, ref_id, first (arrival)."""
    rows = r.src.select(
        F.col(r.record_key).cast("long").alias("record_id"),
        F.col(r.ref_key).cast("long").alias("ref_id"),
        F.col("loaded_at").alias("first"),
        F.col("deleted_at").isNotNull().alias("gone"),
    ).filter(F.col("record_id").isNotNull())
    return (
        rows.groupBy("record_id")
        .agg(F.min("first").alias("first"), F.max("ref_id").alias("ref_id"), F.max("gone").alias("gone"))
        .filter(F.col("ref_id").isNotNull() & ~F.col("gone"))
        .select("record_id", "ref_id", "first")
    )


def _targets(r: Reference) -> DataFrame:
    """Known keys: ref_id, dst_first, dst_gone."""
    return (
        r.dst.select(
            F.col(r.dst_key).cast("long").alias("ref_id"),
            F.col("loaded_at").alias("dst_first"),
            F.col("deleted_at").isNotNull().alias("dst_gone"),
        )
        .filter(F.col("ref_id").isNotNull())
        .groupBy("ref_id")
        .agg(F.min("dst_first").alias("dst_first"), F.max("dst_gone").alias("dst_gone"))
    )


def _resolve(rows: DataFrame, per_key: DataFrame, targets: DataFrame) -> DataFrame:
    """Left join of ``rows`` (with ref_id) to ``targets``: heavy keys by broadcast, the others by shuffle.

    per_key: ref_id, n (number of references).
    """
    total = per_key.agg(F.sum("n").alias("total"))
    heavy = (
        per_key.join(F.broadcast(total), F.col("n") * HEAVY_PARTS > F.col("total"))
        .select("ref_id", F.lit(True).alias("heavy"))
    )
    marked = rows.join(F.broadcast(heavy), "ref_id", "left")
    hot_targets = targets.join(F.broadcast(heavy.select("ref_id")), "ref_id", "left_semi")
    hot = marked.filter("heavy").drop("heavy").join(F.broadcast(hot_targets.withColumn("hit", F.lit(True))), "ref_id", "left")
    cold = marked.filter("heavy is null").drop("heavy").join(targets.withColumn("hit", F.lit(True)), "ref_id", "left")
    return hot.unionByName(cold)


def _late(first: str) -> F.Column:
    return F.col("dst_first") > F.col(first) + F.expr(f"interval {LATE_HOURS} hours")


def _reason(first: str = "first") -> F.Column:
    return (
        F.when(F.col("hit").isNull(), "missing")
        .when(F.col("dst_gone"), "deleted")
        .when(_late(first), "late")
    )


def orphans(refs: list[Reference]) -> DataFrame:
    """src_table, record_id, reason for each record whose reference leads nowhere."""
    out = None
    for r in refs:
        records = _records(r)
        per_key = records.groupBy("ref_id").agg(F.count("*").alias("n"))
        found = (
            _resolve(records, per_key, _targets(r))
            .select(F.lit(r.src_name).alias("src_table"), "record_id", _reason().alias("reason"))
            .filter("reason is not null")
        )
        out = found if out is None else out.unionByName(found)
    return out


def orphan_counts(refs: list[Reference]) -> DataFrame:
    """src_table, month, reason, records: counts per table and month of the record's first arrival.

    References are reduced to one row per key and month before any join.  Such
    a row decides all its records at once unless the late limit falls between
    its earliest and latest arrival; only the records of those rows are joined
    singly.
    """
    out = None
    for r in refs:
        records = _records(r).withColumn("month", F.date_format("first", "yyyy-MM"))
        groups = records.groupBy("ref_id", "month").agg(
            F.count("*").alias("n"), F.count("first").alias("dated"), F.min("first").alias("low"), F.max("first").alias("high")
        )
        per_key = groups.groupBy("ref_id").agg(F.sum("n").alias("n"))
        known = _resolve(groups, per_key, _targets(r))
        low, high = F.coalesce(_late("low"), F.lit(False)), F.coalesce(_late("high"), F.lit(False))
        whole = known.withColumn("all_late", high).withColumn("mixed", F.col("hit").isNotNull() & ~F.col("dst_gone") & low & ~high)
        sure = whole.filter(~F.col("mixed")).select(
            "month", F.when(F.col("hit").isNull(), "missing").when(F.col("dst_gone"), "deleted").when(F.col("all_late"), "late").alias("reason"),
            F.when(F.col("hit").isNotNull() & ~F.col("dst_gone"), F.col("dated")).otherwise(F.col("n")).alias("n"),
        ).filter("reason is not null")
        split = whole.filter("mixed").select("ref_id", "month", "dst_first")
        singly = (
            records.join(split, ["ref_id", "month"])
            .filter(_late("first"))
            .select("month", F.lit("late").alias("reason"), F.lit(1).cast("long").alias("n"))
        )
        found = sure.unionByName(singly).groupBy("month", "reason").agg(F.sum("n").alias("records"))
        found = found.select(F.lit(r.src_name).alias("src_table"), "month", "reason", "records")
        out = found if out is None else out.unionByName(found)
    return out
