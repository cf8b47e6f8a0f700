"""Mixing sources to target weights: hash-random order, prefix sums, a cut at each budget.

Every row gets a random key, 52 bits of a seeded hash of its id; a source's rows are ordered by
it. Distributed prefix sums of the sizes along that order say where the source's budget is
spent: whole epochs first, then the rows up to the cut. Built-in functions only.

Targets. Sources in code point order (NULL last) weigh 1, 2, 3, repeating, and share all
words by weight; a target stops at ``MOST_EPOCHS`` times its source's size and the excess is
shared again by weight until no target is above. That is a water level: the target is the
smaller of cap and level * weight, so sources sorted by cap / weight and prefix sums give it
at once. The sources' own table (a row per source) is what those windows order.

Defined results. Rows are taken whole; the row that straddles the cut goes in if half of it
or more lies before the cut, so a source misses its target by half a row at most. NULL and
blank texts have size 0 and take 0 words. A NULL source is a source of its own. Ties of the
key are ordered by id, size and text hash; rows equal in all of these are interchangeable.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.runtime import settle
from fleetrisk.llm.numbering import bucket_of, running_sum

MOST_EPOCHS = 3
SEED = "mix-1"
#: Up to so many sources their targets go to every task; beyond, the join is by shuffle.
BROADCAST_SOURCES = 20_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rows, target) from rows with ``source`` and ``size``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    per = per.withColumn("cap", (MOST_EPOCHS * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    capped = F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    # The level if all earlier sources are at their caps; it holds at the first source whose cap it doesn't reach.
    level = (total - capped) / F.sum("weight").over(onward)
    ratio = F.col("cap") / F.col("weight")
    first = F.min(F.when(level <= ratio, F.struct(F.row_number().over(by_ratio).alias("at"), level.alias("level"))))
    level = first.over(everything)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return per.select("source", "source_size", "rows", target.alias("target"))


def _group(source: Column) -> Column:
    """The source as a key that is never NULL."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _keyed(seed: str) -> list[Column]:
    """What a row is ordered by, and its source's key."""
    text = F.col("text").cast("string")
    drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return [
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
        # 52 random bits: exact as a double in [0, 1).
        (F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10).cast("bigint") / float(1 << 52)).alias("key"),
        F.xxhash64(text).alias("tie"), _group(F.col("source").cast("string")).alias("group"),
    ]


def _epochs() -> Column:
    """Whole epochs of a source within its target."""
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))


def _beyond() -> Column:
    """Whether a row gets one copy more than the whole epochs."""
    rest = F.col("target") - _epochs() * F.col("source_size")
    return (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 < rest)


def _ordered(documents: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Slim rows with the words before each one in its source's order, and the sources' table."""
    slim = settle(documents.select(*_keyed(seed), F.col("source").cast("string").alias("source")), "mix")
    per = settle(targets(slim).withColumn("group", _group(F.col("source"))).drop("source"), "targets")
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    slim = slim.drop("source").join(per, "group").withColumn("bucket", bucket_of(F.col("key"), F.col("rows")))
    return running_sum(slim, "group", "bucket", ["key", "doc_id", "size", "tie"], F.col("size"), "before"), per


def mix_documents(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document row: size, source size, target, copies and words taken."""
    rows, _ = _ordered(documents, seed)
    copies = _epochs() + F.when(_beyond(), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(copies, F.lit(MOST_EPOCHS))).otherwise(F.lit(0)).cast("bigint")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                       copies.alias("copies"))


def mixed(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``documents`` that the mix takes, once for each copy.

    Texts are not dealt out: the slim order gives every source the last place that gets the
    copy of the cut epoch, and rows are held against their source's place where they lie.
    Only rows that share that place, repeats of one row, are numbered among themselves.
    """
    order = ["key", "doc_id", "size", "tie"]
    slim, per = _ordered(documents, seed)
    # The copy beyond the whole epochs goes to a beginning of the order: its last place and the rows there.
    place = F.struct(*order)
    cuts = (slim.where(_beyond()).groupBy("group", place.alias("place")).agg(F.count(F.lit(1)).alias("there"))
            .groupBy("group").agg(F.max(F.struct("place", "there")).alias("last")))
    cuts = per.join(cuts, "group", "left").select("group", _epochs().alias("epochs"), "last")
    cuts = settle(cuts, "cuts")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row")
    rows = documents.select(row, *_keyed(seed)).join(cuts, "group")
    rows = rows.withColumn("__side", F.when(F.col("size") == 0, F.lit(None)).when(F.col("last").isNull(), 1)
                           .when(place < F.col("last.place"), -1).when(place == F.col("last.place"), 0).otherwise(1))
    sure = rows.where("__side <> 0").select("__row", (F.col("epochs") + F.when(F.col("__side") < 0, 1).otherwise(0)).alias("copies"))
    tied = settle(rows.where("__side = 0").select("__row", "group", "epochs", F.col("last.there").alias("there")), "tied")
    tied = tied.withColumns({"at": F.monotonically_increasing_id(), "bucket": F.spark_partition_id()})
    tied = running_sum(tied, "group", "bucket", ["at"], F.lit(1), "before")
    tied = tied.select("__row", (F.col("epochs") + F.when(F.col("before") < F.col("there"), 1).otherwise(0)).alias("copies"))
    copies = F.least("copies", F.lit(MOST_EPOCHS)).cast("bigint")
    taken = sure.union(tied).select("__row", copies.alias("copies")).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("__row.*")
