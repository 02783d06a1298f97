"""Change detection between listings of a source, and append-only versions.

A listing row without an item id has no identity and is left out. Items listed twice are listed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "item_id"]


def has_changed() -> Column:
    """Ladder over the joined row (new_* and old_*): change tokens decide if both sides have one; equal size and second of
    change mean unchanged; a remote file is then judged by size; else by hash, an unreadable file being unchanged."""
    tokens = F.col("new_etag").isNotNull() & F.col("old_etag").isNotNull()
    print_ = (F.col("new_size") == F.col("old_size")) & (F.date_trunc("second", "new_modified") == F.date_trunc("second", "old_modified"))
    return (
        F.when(tokens, F.col("new_etag") != F.col("old_etag"))
        .when(F.coalesce(print_, F.lit(False)), False)
        .when(F.coalesce(F.col("is_remote"), F.lit(False)), ~F.col("new_size").eqNullSafe(F.col("old_size")))
        .when(F.col("new_hash").isNull(), False)
        .when(F.col("old_hash").isNull(), True)
        .otherwise(F.col("new_hash") != F.col("old_hash"))
    )


def snapshot_diff(listing: DataFrame, index: DataFrame) -> DataFrame:
    """source_id, item_id, outcome: NEW, MODIFIED, UNCHANGED, or MISSING for active items of listed sources that are not
    listed any more. One full outer join. listing: KEY, etag, size, modified, hash, is_remote; index: KEY, etag, size,
    modified, hash, active."""
    facts = ["etag", "size", "modified", "hash"]
    new = listing.filter(F.col("item_id").isNotNull()).dropDuplicates(KEY)
    new = new.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in facts], "is_remote", F.lit(True).alias("listed"))
    old = index.dropDuplicates(KEY).select(*KEY, *[F.col(c).alias(f"old_{c}") for c in facts], "active", F.lit(True).alias("known"))
    both = new.join(old, KEY, "full_outer")
    outcome = (
        F.when(F.col("known").isNull(), "NEW")
        .when(F.col("listed").isNull(), F.when(F.col("active"), "MISSING"))
        .when(has_changed(), "MODIFIED")
        .otherwise("UNCHANGED")
    )
    return both.select(*KEY, outcome.alias("outcome")).filter(F.col("outcome").isNotNull())


def lifecycle(listing: DataFrame, index: DataFrame) -> DataFrame:
    """KEY, outcome, restored, reactivated: as `snapshot_diff`; listed items that were deleted are restored, unchanged ones that
    were inactive are active again. index also has `deleted`."""
    known = index.dropDuplicates(KEY).select(*KEY, F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("active", F.lit(False)).alias("active"))
    rows = snapshot_diff(listing, index).join(known, KEY, "left")
    listed = F.col("outcome") != "MISSING"
    return rows.select(
        *KEY, "outcome", (listed & F.coalesce("deleted", F.lit(False))).alias("restored"), ((F.col("outcome") == "UNCHANGED") & ~F.coalesce("active", F.lit(True))).alias("reactivated")
    )


def next_index(listing: DataFrame, index: DataFrame, now: Column) -> DataFrame:
    """The index after a complete listing: facts of the file (etag, size, modified, hash) from the listing where it is new or
    changed, what people curated (title, code) as it was, listed items active, missing ones inactive since `now`. index also
    has title, code, missing_since. Items of sources that were not listed stay as they are."""
    facts, kept = ["etag", "size", "modified", "hash"], ["title", "code", "missing_since", "active"]
    new = listing.filter(F.col("item_id").isNotNull()).dropDuplicates(KEY).select(*KEY, *[F.col(c).alias(f"new_{c}") for c in facts])
    old = index.dropDuplicates(KEY).select(*KEY, *[F.col(c).alias(f"old_{c}") for c in facts], *kept)
    sources = listing.select("source_id").distinct().withColumn("scanned", F.lit(True))
    rows = old.join(new, KEY, "full_outer").join(snapshot_diff(listing, index), KEY, "left").join(F.broadcast(sources), "source_id", "left")  # a row a source
    changed = F.col("outcome").isin("NEW", "MODIFIED")
    lost = (F.col("outcome") == "MISSING") & F.coalesce("scanned", F.lit(False))
    listed = F.col("outcome").isNotNull() & (F.col("outcome") != "MISSING")
    return rows.select(
        *KEY, *[F.when(changed, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in facts], "title", "code",
        F.when(lost, False).when(listed, True).otherwise(F.col("active")).alias("active"),
        F.when(lost, now).when(~listed | F.col("outcome").isNull(), F.col("missing_since")).alias("missing_since"),
    )


def append_versions(versions: DataFrame, changed: DataFrame) -> DataFrame:
    """document_id, version_number, revision_label, file_hash, is_current: the versions after changed documents (document_id,
    revision_label, file_hash) got a new one. Numbers go on from the greatest ever given; older versions stop being current."""
    old = versions.dropDuplicates(["id"]).select("document_id", "version_number", "revision_label", "file_hash", "is_current")
    new = changed.dropDuplicates(["document_id"]).select("document_id", "revision_label", "file_hash")
    last = old.groupBy("document_id").agg(F.max("version_number").alias("last"))
    added = new.join(last, "document_id", "left").select("document_id", (F.coalesce("last", F.lit(0)) + 1).alias("version_number"), "revision_label", "file_hash", F.lit(True).alias("is_current"))
    demoted = old.join(new.select("document_id", F.lit(True).alias("changed")), "document_id", "left")
    return demoted.withColumn("is_current", F.col("is_current") & F.col("changed").isNull()).drop("changed").unionByName(added)


def scan_log(counters: DataFrame) -> DataFrame:
    """source_id, status, message of finished scans: counters (see `scan_counters`) with error_count and duration_ms."""
    names = ("total_found", "new_files", "modified_files", "unchanged_files", "deleted_files", "queued_for_analysis", "error_count")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in names]
    said = F.format_string("%d found · %d new · %d modified · %d unchanged · %d missing · %d queued · %d errors", *counts)
    status = F.when(counts[-1] > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    return counters.select("source_id", status.alias("status"), "duration_ms", said.alias("message"))


def scan_counters(diff: DataFrame) -> DataFrame:
    """source_id and the number of files by outcome."""
    count = lambda x: F.count_if(F.col("outcome") == x)
    return diff.groupBy("source_id").agg(
        F.count_if(F.col("outcome") != "MISSING").alias("total_found"), count("NEW").alias("new_files"), count("MODIFIED").alias("modified_files"),
        count("UNCHANGED").alias("unchanged_files"), count("MISSING").alias("deleted_files"),
        F.count_if(F.col("outcome").isin("NEW", "MODIFIED")).alias("queued_for_analysis"),
    )


def next_versions(diff: DataFrame, versions: DataFrame) -> DataFrame:
    """KEY, version_number of the versions that the changed items get. versions: KEY, version_number."""
    changed = diff.filter(F.col("outcome").isin("NEW", "MODIFIED")).select(*KEY)
    last = versions.groupBy(*KEY).agg(F.max("version_number").alias("last"))
    return changed.join(last, KEY, "left").select(*KEY, (F.coalesce("last", F.lit(0)) + 1).alias("version_number"))


def current_versions(versions: DataFrame) -> DataFrame:
    """id, document_id, version_number, current, changed: whether a version is its document's newest, and whether its content
    differs from the one before."""
    rows = versions.dropDuplicates(["id"])
    doc = Window.partitionBy("document_id")
    newest = F.row_number().over(doc.orderBy(F.desc("version_number"), F.desc("id"))) == 1
    before = F.lag("file_hash").over(doc.orderBy("version_number", "id"))
    return rows.select("id", "document_id", "version_number", newest.alias("current"), (~F.col("file_hash").eqNullSafe(before)).alias("changed"))
