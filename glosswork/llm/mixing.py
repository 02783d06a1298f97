"""Mixing sources to target weights (problem 8).

Every record of a source with a target gets a hash-random key; a source's records stand in the order of their
keys. The keys' upper bits range-partition each source into buckets; bucket totals (combined before their
shuffle) give distributed prefix sums, and only the bucket that holds the cut is summed record by record.
A source whose budget exceeds its tokens is repeated whole, up to its cap, and cut in its last epoch. What the record at
the cut leaves of the budget is filled, in FILLS rounds, by the largest record not yet taken in that epoch that fits.

Edge cases: null and empty texts have no tokens and are never chosen; records delivered twice count once;
sources without records reach nothing and are reported so; a target named twice counts once (its larger share);
sources without a target contribute nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm import tokens
from glosswork.session import cut_lineage

#: upper bits of the key that name the bucket: a source has up to 2^14 buckets, and a bucket a like part of its records
BITS = 14
#: rounds in which the rest of a budget is filled, and the part of a budget that may be missing where it counts as reached
FILLS, TOLERANCE = 4, 0.01


def _counted(documents: DataFrame, targets: DataFrame, seed: int, path: str) -> tuple[DataFrame, DataFrame]:
    goals = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = documents.select("doc_id", "source", "text").filter(F.length("text") > 0).join(goals.select("source"), "source", "left_semi")
    key = F.xxhash64("doc_id", F.lit(seed))
    rows = docs.select("doc_id", "source", tokens.count(F.col("text"), path).alias("n_tokens"), key.alias("key")).dropDuplicates(["doc_id"])
    bucket = F.shiftrightunsigned("key", 64 - BITS).alias("bucket")
    # a few numbers a record, read by the totals and by the choice: tokenized once
    return cut_lineage(rows.select("*", bucket)), goals


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, path: str = tokens.TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: doc_id, source, n_tokens, repeats; shares: source, target_share, budget, available, chosen
    tokens, repeats_used, actual_share, reached.

    `total` is the size of the mixture in tokens, by default all tokens of the sources that have a target.
    """
    rows, goals = _counted(documents, targets, seed, path)
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source").orderBy("bucket")  # at most 2^BITS rows a source
    before = sums.withColumn("before", F.sum("n").over(order) - F.col("n"))
    have = sums.groupBy("source").agg(F.sum("n").alias("available"))
    all_ = goals.join(have, "source", "left").na.fill({"available": 0})
    size = F.lit(total).cast("bigint") if total is not None else F.sum("available").over(Window.partitionBy(F.lit(1)))
    plan = all_.withColumn("budget", F.floor(F.col("target_share") * size).cast("bigint"))
    full = F.when(F.col("available") > 0, F.least(F.expr("budget div greatest(available, 1)"), F.col("max_repeats").cast("bigint"))).otherwise(0)
    plan = plan.withColumn("epochs", F.greatest(full, F.lit(0)).cast("bigint"))
    rest = F.when(F.col("epochs") >= F.col("max_repeats"), 0).otherwise(F.col("budget") - F.col("epochs") * F.col("available"))
    plan = plan.withColumn("rest", F.greatest(rest, F.lit(0)))
    where = before.join(plan.select("source", "epochs", "rest"), "source")
    kind = F.when(F.col("before") + F.col("n") <= F.col("rest"), "in").when(F.col("before") >= F.col("rest"), "out").otherwise("cut")
    placed = rows.join(where.select("source", "bucket", "before", "epochs", "rest", kind.alias("kind")), ["source", "bucket"])
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id")
    sure = placed.filter("kind <> 'cut'").select("doc_id", "source", "n_tokens", (F.col("epochs") + (F.col("kind") == "in").cast("int")).alias("repeats"))
    cut = placed.filter("kind = 'cut'").withColumn("sum", F.col("before") + F.sum("n_tokens").over(inner))
    cut = cut.select("doc_id", "source", "n_tokens", (F.col("epochs") + (F.col("sum") <= F.col("rest")).cast("int")).alias("repeats"))
    placed = cut_lineage(sure.unionByName(cut).withColumn("repeats", F.col("repeats").cast("int")))  # numbers, read by every round
    taken = placed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("taken"))
    open_ = plan.join(taken, "source").select("source", "epochs", (F.col("budget") - F.col("taken")).alias("left"), "max_repeats")
    open_ = open_.filter((F.col("epochs") < F.col("max_repeats")) & (F.col("left") > 0))
    for _ in range(FILLS):
        free = placed.join(F.broadcast(open_), "source").filter((F.col("repeats") <= F.col("epochs")) & (F.col("n_tokens") <= F.col("left")) & (F.col("n_tokens") > 0))  # a row a source
        more = free.groupBy("source").agg(F.max(F.struct("n_tokens", "doc_id")).alias("m")).select("source", F.col("m.doc_id").alias("doc_id"), F.col("m.n_tokens").alias("own"))
        more = cut_lineage(more)
        open_ = open_.join(more, "source", "left").withColumn("left", F.col("left") - F.coalesce("own", F.lit(0))).drop("own", "doc_id")
        placed = placed.join(F.broadcast(more.drop("own").withColumn("again", F.lit(1))), ["source", "doc_id"], "left")
        placed = placed.withColumn("repeats", F.col("repeats") + F.coalesce("again", F.lit(0))).drop("again")
    chosen = placed.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("chosen_tokens"), F.max("repeats").alias("repeats_used"))
    shares = plan.join(got, "source", "left").na.fill({"chosen_tokens": 0, "repeats_used": 0})
    whole = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    shares = shares.select(
        "source", "target_share", "max_repeats", "budget", "available", "chosen_tokens", "repeats_used",
        F.round(F.try_divide(F.col("chosen_tokens"), whole), 6).alias("actual_share"),
        (F.col("chosen_tokens") >= F.col("budget") * (1 - TOLERANCE)).alias("reached"),
    )
    return chosen, shares
