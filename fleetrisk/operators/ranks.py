"""Distributed order statistics: prefix sums, exact quantiles, mid-ranks, dense numbers.

A window ordered over the whole table moves every row into one task, and the built-in
exact ``percentile`` keeps all distinct values of a group in one task. Here rows are
first counted per distinct value (map-side combined, so a value held by a third of the
rows becomes one row), the values are cut into many ordered buckets by a fixed monotone
rule, and only the bucket totals - a number of rows bounded by the bucket count - are
put in sequence. Each bucket then finishes on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.columns import num, stamp

LINEAR_BUCKETS = 4096
HASH_BUCKETS = 1024
#: Distinct values (or rows to number) of a bucket, above which it is cut again.
BUCKET_ROWS = 20_000
_BUCKET = ["__lin", "__log", "__fine"]


def _with_buckets(counts: DataFrame, source: DataFrame, value: str) -> DataFrame:
    """Add two monotone bucket numbers: equal widths over the range, and log widths.

    Both depend on nothing but the value and the exact range, so every evaluation of
    the plan cuts at the same places. Together they stay fine-grained for both narrow
    and long-tailed data.
    """
    finite = F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.lit(1e300)), F.lit(-1e300)))
    span = source.agg(F.struct(F.min(finite).alias("lo"), F.max(finite).alias("hi")).alias("span")).scalar()
    counts = counts.withColumn("__span", span)
    low = F.col("__span").getField("lo")
    width = F.col("__span").getField("hi") - low
    linear = F.when(width > 0, F.floor((finite - low) / width * F.lit(float(LINEAR_BUCKETS - 1)))).otherwise(F.lit(0))
    log = F.signum(finite) * F.floor(F.log1p(F.abs(finite) * F.lit(1e6)) * F.lit(64.0))
    return counts.withColumns({"__lin": F.coalesce(linear.cast("int"), F.lit(0)),
                               "__log": F.coalesce(log.cast("int"), F.lit(0))}).drop("__span")


def _cut_again(counts: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Add a third bucket number: a bucket of too many rows is cut into equal widths of its own range.

    Values that crowd together beside far outliers fall into one bucket of the first cut.
    Range and row count of a bucket are exact, so this cut too is the same in every evaluation.
    """
    finite = F.greatest(F.least(F.col(value), F.lit(1e300)), F.lit(-1e300))
    first = [*keys, "__lin", "__log"]
    spans = counts.groupBy(*first).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"),
                                       F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_ROWS)).alias("__parts"))
    # Buckets of moderate size, which is nearly all of them, need no entry.
    spans = spans.filter((F.col("__parts") > 1) & (F.col("__hi") > F.col("__lo")))
    share = (finite - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    fine = F.coalesce(F.floor(share * F.col("__parts")).cast("bigint"), F.lit(0).cast("bigint"))
    return (counts.join(spans, first, "left").withColumn("__fine", fine)
            .drop("__lo", "__hi", "__parts"))


def _sequenced(counts: DataFrame, buckets: Sequence[str], measures: Sequence[str],
               keys: Sequence[str], keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Join each row's bucket offsets (``<m>__off``) and key totals (``<m>_total``)."""
    totals = counts.groupBy(*keys, *buckets).agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    cols = {f"{m}__off": F.coalesce(F.sum(m).over(before), F.lit(0)) for m in measures}
    cols |= {f"{m}_total": F.sum(m).over(whole) for m in measures}
    offsets = totals.withColumns(cols)
    if keep is not None:
        offsets = offsets.filter(keep(offsets))
    offsets = offsets.drop(*measures)
    return counts.join(offsets, [*keys, *buckets])


def prefix_sums(df: DataFrame, value: str, measures: Mapping[str, Column], keys: Sequence[str] = (),
                keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """One row per (keys, value) with each summed measure, its total, and its sum over smaller values.

    Output columns: keys, ``value``, and for each measure ``m``: ``m``, ``m_before``,
    ``m_total``. Rows with a NULL value or key are left out.
    """
    keys = list(keys)
    source = df.dropna(subset=keys) if keys else df
    present = F.col(value).isNotNull()
    counts = source.groupBy(*keys, value).agg(*[
        F.coalesce(F.sum(F.when(present, m)), F.lit(0)).alias(name) for name, m in measures.items()])
    counts = _cut_again(_with_buckets(counts, source, value), value, keys)
    names = list(measures)
    placed = _sequenced(counts, _BUCKET, names, keys, keep)
    inside = (Window.partitionBy(*keys, *_BUCKET).orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumns({
        f"{m}_before": F.col(f"{m}__off") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in names
    })
    # The one row for NULL weighs nothing and is dropped here, above the window: as a filter
    # on the source it would be pushed into, and multiply, the expression behind the value.
    out = placed.select(*keys, value, *[c for m in names for c in (m, f"{m}_before", f"{m}_total")])
    return out.filter(F.col(value).isNotNull())


def _positions(probs: Mapping[str, float], total: Column) -> dict[str, Column]:
    return {alias: F.lit(float(p)) * (total - F.lit(1)).cast("double") for alias, p in probs.items()}


def grouped_quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
                      keys: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles per key: one column per entry of ``probs``.

    Only the buckets that hold a wanted rank are sorted.
    """
    keys = list(keys)

    def wanted(offsets: DataFrame) -> Column:
        start, size = F.col("__n__off"), F.col("__n")
        test = F.lit(False)
        for pos in _positions(probs, F.col("__n_total")).values():
            test = test | ((start <= F.ceil(pos)) & (F.floor(pos) < start + size))
        return test

    placed = prefix_sums(df.select(*keys, value), value, {"__n": F.lit(1)}, keys, keep=wanted)
    aggs = []
    for alias, pos in _positions(probs, F.col("__n_total")).items():
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("__n_before") <= rank) & (rank < F.col("__n_before") + F.col("__n"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"{alias}__{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"{alias}__w"))
    found = placed.groupBy(*keys).agg(*aggs)
    out = [(F.col(f"{a}__lo") + (F.col(f"{a}__hi") - F.col(f"{a}__lo")) * F.col(f"{a}__w")).alias(a)
           for a in probs]
    return found.select(*keys, *out)


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
         name: str = "feature", value: str = "value") -> DataFrame:
    """Long form (keys, feature, value) of numeric columns; NULL values are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), num(df, c).alias(value)) for c in columns])
    long = df.select(*keys, F.inline(pairs))
    return long.filter(F.col(value).isNotNull())


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float],
                     keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of several columns in one pass: columns ``<column>__<alias>`` per key."""
    long = grouped_quantiles(melt(df, columns, keys), "value", probs, [*keys, "feature"])
    cells = [F.max(F.when(F.col("feature") == c, F.col(a))).alias(f"{c}__{a}")
             for c in columns for a in probs]
    return long.groupBy(*keys).agg(*cells)


def scalar_row(df: DataFrame) -> Column:
    """A one-row frame as a struct that other plans read as a scalar subquery."""
    names = df.schema.names
    return df.agg(F.first(F.struct(*names)).alias("row")).scalar()


def mid_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average rank (1-based) of each distinct value, with its count: keys, value, n, mid_rank."""
    placed = prefix_sums(df, value, {"n": F.lit(1)}, keys)
    rank = F.col("n_before").cast("double") + (F.col("n").cast("double") + F.lit(1.0)) / F.lit(2.0)
    return placed.withColumn("mid_rank", rank)


def dense_numbers(df: DataFrame, name: str, order_by: str | None = None, chunk: int = 100_000) -> DataFrame:
    """Number the rows 0, 1, 2, ... without bringing them together.

    Equal rows are interchangeable, so they are counted first and expanded again in
    chunks at the end. Order: by ``order_by`` (numeric or time, best near-unique), then
    by content hash.
    """
    cols = df.schema.names
    counted = df.withColumn("__hash", F.xxhash64(*cols)).groupBy(*cols, "__hash").agg(
        F.count(F.lit(1)).alias("__n"))
    if order_by is None:
        counted = counted.withColumn("__bucket", F.pmod("__hash", F.lit(HASH_BUCKETS)))
        buckets, order = ["__bucket"], ["__hash"]
    else:
        kind = df.schema[order_by].dataType.simpleString()
        at = (F.unix_micros(stamp(df, order_by).cast("timestamp")).cast("double")
              if kind.startswith("timestamp") or kind == "date" else num(df, order_by))
        at = F.coalesce(at, F.lit(1e300))
        counted = _with_buckets(counted.withColumn("__at", at), df.select(at.alias("__at")), "__at")
        counted = _cut_again(counted, "__at", [])
        buckets, order = _BUCKET, ["__at", "__hash"]
    placed = _sequenced(counted, buckets, ["__n"], [])
    inside = (Window.partitionBy(*buckets).orderBy(*order, *cols)
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("__n__off") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    placed = placed.withColumn("__start", start)
    last = F.floor((F.col("__n") - F.lit(1)) / F.lit(chunk)).cast("long")
    chunks = placed.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first_in = F.col("__chunk") * F.lit(chunk)
    last_in = F.least(first_in + F.lit(chunk - 1), F.col("__n") - F.lit(1))
    rows = chunks.withColumn("__offset", F.explode(F.sequence(first_in, last_in)))
    return rows.select(*cols, (F.col("__start") + F.col("__offset")).alias(name))
