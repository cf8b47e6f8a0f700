"""Scaling, label synthesis, classification metrics and statistical tests.

Ranks come from per-value counts and bucketed prefix sums (``ranks``), so ties and hot
values are one row each and no test sorts the table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetrisk import constants as K
from fleetrisk.functions import pricing as px
from fleetrisk.functions.columns import bound, clip, half_even, has, num
from fleetrisk.functions.distributions import p_value
from fleetrisk.operators.filters import driving_only
from fleetrisk.operators.ranks import column_quantiles, grouped_quantiles, melt, prefix_sums, scalar_row

FLOOR = 1e-6


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric and true/false feature columns, picked from the schema."""
    skip = set(K.ID_COLUMNS) | set(K.TARGET_COLUMNS)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    """Categorical feature columns, picked from the schema."""
    skip = set(K.ID_COLUMNS) | set(K.TARGET_COLUMNS)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.StringType)]


def minmax_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    """M1"""
    value = num(df, column, 0.0)
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("span")).scalar()
    df = df.withColumn("__span", span)
    low, high = F.col("__span").getField("lo"), F.col("__span").getField("hi")
    width = F.greatest(high - low, F.lit(FLOOR))
    return df.withColumn(name, bound((value - low) / width, 0.0, 1.0)).drop("__span")


def bounded_scale(df: DataFrame, columns: dict[str, Column], quantile: float = 0.95) -> DataFrame:
    """M2: each value over its exact upper quantile, 0..1; all columns in one pass."""
    staged = df.withColumns({f"__in_{name}": F.coalesce(value, F.lit(0.0)) for name, value in columns.items()})
    names = [f"__in_{name}" for name in columns]
    row = scalar_row(column_quantiles(staged.select(*names), names, {"q": quantile}))
    staged = staged.withColumn("__caps", row)
    out = {}
    for name in columns:
        cap = F.greatest(F.col("__caps").getField(f"__in_{name}__q"), F.lit(FLOOR))
        out[name] = bound(F.col(f"__in_{name}") / cap, 0.0, 1.0)
    return staged.withColumns(out).drop("__caps", *names)


def synthesize_targets(df: DataFrame, seed: int = 42, drop: bool = True) -> DataFrame:
    """M3: raw risk of driving rows, its 65th-percentile label, and a hash-drawn claim."""
    df = driving_only(df)
    parts = ("Harsh_Brake_Count", "Harsh_Accel_Count", "Harsh_Corner_Count")
    if has(df, "Total_Harsh_Events_per_Day"):
        harsh = num(df, "Total_Harsh_Events_per_Day")
    else:
        harsh = num(df, parts[0], 0.0) + num(df, parts[1], 0.0) + num(df, parts[2], 0.0)
    # An absent column counts as 0; where a column is there, its empty cells leave the ratios empty.
    rpm, load, speed = (num(df, c) if has(df, c) else F.lit(0.0) for c in ("RPM", "Engine_Load_pct", "Speed_kmh"))
    df = df.withColumns({"__harsh": harsh, "RPM_per_Speed": rpm / (speed + F.lit(0.1)),
                         "Load_per_RPM": load / (rpm + F.lit(0.1))})
    inputs = {
        "__speeding": num(df, "Speeding_Excess_kmh", 0.0), "__recent": num(df, "Recent_Harsh_Events", 0.0),
        "__trip": F.coalesce(num(df, "Trip_Duration_Hour") + num(df, "Trip_Distance_km") / F.lit(40.0), F.lit(0.0)),
        "__engine": num(df, "Engine_Load_pct", 0.0), "__fuel": num(df, "Fuel_Efficiency_L_per_100km", 0.0),
    }
    df = df.withColumns(inputs)
    # The scales and the label cut are fitted: each is one row of exact, distributed statistics.
    caps = column_quantiles(df.select(*inputs), list(inputs), {"q": 0.95}).first()
    df = df.withColumns({name: bound(F.col(name) / F.lit(max(caps[f"{name}__q"], FLOOR)), 0.0, 1.0)
                         for name in inputs} if caps else {name: F.lit(0.0) for name in inputs})
    raw = (F.lit(0.28) * (F.col("__harsh") / (F.lit(1.0) + F.col("__harsh"))) + F.lit(0.22) * F.col("__speeding")
           + F.lit(0.18) * F.col("__recent") + F.lit(0.16) * F.col("__trip") + F.lit(0.10) * F.col("__engine")
           + F.lit(0.06) * F.col("__fuel"))
    df = df.withColumn("__raw", F.coalesce(raw, F.lit(0.0)))
    low, high = df.agg(F.min("__raw"), F.max("__raw")).first()
    low, high = low or 0.0, high or 0.0
    df = df.withColumn("Risk_Score", bound((F.col("__raw") - F.lit(low)) / F.lit(max(high - low, FLOOR)), 0.0, 1.0))
    cut = grouped_quantiles(df.select("Risk_Score"), "Risk_Score", {"cut": 0.65}).first()
    chance = bound(F.lit(0.02) + F.lit(0.40) * F.col("Risk_Score") + F.lit(0.08) * F.col("__engine"), 0.01, 0.95)
    df = df.withColumns({
        "Risk_Label": (F.col("Risk_Score") >= F.lit(cut["cut"] if cut else 0.0)).cast("int"),
        "Claim_Probability": half_even(chance, 4),
    })
    draw = F.pmod(F.xxhash64("Plate", "Last_Update", F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    df = df.withColumn("Claim_Label", (draw < F.col("Claim_Probability")).cast("int"))
    df = df.drop("__harsh", "__speeding", "__recent", "__trip", "__engine", "__fuel", "__raw")
    return df.drop(*K.TRAINING_DROPPED) if drop else df


# --- ranks-based statistics --------------------------------------------------

def _label_sums(df: DataFrame, value: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: positives and negatives here, below, and in all."""
    return prefix_sums(df, value, {"pos": (F.col(label) == 1).cast("long"),
                                   "neg": (F.col(label) == 0).cast("long")}, keys)


def auc_by_key(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve and average precision, from per-score counts."""
    placed = _label_sums(df, score, label, keys)
    pairs = F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    precision = F.try_divide(tp, tp + fp)
    return placed.groupBy(*keys).agg(
        F.try_divide(F.sum(pairs), F.max("pos_total") * F.max("neg_total").cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.max("pos_total")).alias("average_precision"))


def classification_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """Accuracy, AUC, average precision, F1, precision, recall, Brier score and log loss."""
    p, y = F.col(score), F.col(label)
    hit = (p >= 0.5).cast("int")
    safe = bound(p, 2.220446049250313e-16, 1.0 - 2.220446049250313e-16)
    loss = -(y * F.ln(safe) + (F.lit(1) - y) * F.ln(F.lit(1.0) - safe))
    tp, n = F.sum((hit * y).cast("long")), F.count(F.lit(1))
    row = df.agg(
        F.avg((hit == y).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(F.lit(2.0) * tp, F.sum(hit) + F.sum(y)), F.lit(0.0)).alias("f1_score"),
        F.coalesce(F.try_divide(tp, F.sum(hit)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.sum(y)), F.lit(0.0)).alias("recall"),
        F.avg((p - y) * (p - y)).alias("brier_score"), F.avg(loss).alias("log_loss"), n.alias("n"))
    ranked = scalar_row(auc_by_key(df, score, label))
    return row.withColumn("__r", ranked).select("*", "__r.*").drop("__r")


def mann_whitney(df: DataFrame, columns: Sequence[str] | None = None, label: str = "Risk_Label") -> DataFrame:
    """Two-sided U test of every numeric column, tie-corrected normal approximation."""
    columns = [c for c in (columns or numeric_columns(df)) if c != label]
    long = melt(df, columns, [label])
    placed = _label_sums(long, "value", label, ["feature"])
    n = F.col("pos") + F.col("neg")
    row = placed.groupBy("feature").agg(
        F.max("pos_total").alias("n_group1"), F.max("neg_total").alias("n_group0"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))).alias("u"),
        F.sum(n.cast("double") * n * n - n).alias("ties"))
    n1, n0 = F.col("n_group1").cast("double"), F.col("n_group0").cast("double")
    size = n1 + n0
    spread = F.sqrt(n1 * n0 / F.lit(12.0) * (size + F.lit(1.0) - F.col("ties") / (size * (size - F.lit(1.0)))))
    enough = (n1 >= 3) & (n0 >= 3)
    gap = F.abs(F.col("u") - n1 * n0 / F.lit(2.0)) - F.lit(0.5)
    row = row.withColumns({
        "statistic": F.when(enough, F.col("u")), "z": F.when(enough, F.try_divide(gap, spread)),
        "error": F.when(~enough, F.lit("insufficient_group_data"))})
    # Without any spread, or within the continuity correction, nothing speaks for a difference.
    z = F.greatest(F.col("z"), F.lit(0.0))
    row = row.withColumn("pvalue", F.when(F.col("statistic").isNotNull(),
                                          F.coalesce(p_value("normal", z), F.lit(1.0))))
    return row.select("feature", "statistic", "z", "pvalue", "n_group1", "n_group0", "error")


def chi_square(df: DataFrame, columns: Sequence[str] | None = None, label: str = "Risk_Label") -> DataFrame:
    """Category by label; a 2x2 table takes the Yates correction."""
    columns = list(columns or text_columns(df))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("Missing"))
                               .alias("level")) for c in columns])
    long = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.inline(cells))
    counts = long.groupBy("feature", "level", "label").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("feature", "level").agg(F.sum("n").alias("row_n"))
    sides = counts.groupBy("feature", "label").agg(F.sum("n").alias("side_n"))
    by_row = rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_levels"), F.sum("row_n").cast("double").alias("total"),
        (F.min("row_n").cast("double") * F.max("row_n")).alias("row_product"))
    by_side = sides.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_labels"), (F.min("side_n").cast("double") * F.max("side_n")).alias("side_product"))
    shape = by_row.join(by_side, "feature")
    cells = counts.join(rows, ["feature", "level"]).join(sides, ["feature", "label"]).join(shape, "feature")
    expected = F.col("row_n").cast("double") * F.col("side_n") / F.col("total")
    gap = F.col("n") - expected
    sums = cells.groupBy("feature").agg(
        F.sum(gap * gap / expected).alias("seen"), F.sum(expected).alias("seen_expected"),
        F.max(F.abs(gap)).alias("gap"),
        *[F.max(c).alias(c) for c in ("n_levels", "n_labels", "total", "row_product", "side_product")])
    # Cells that never occur add their expected count, which is what the seen cells leave over.
    plain = F.col("seen") + (F.col("total") - F.col("seen_expected"))
    # In a 2x2 table all four gaps are equal, and so is the correction.
    near = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    total = F.col("total")
    yates = near * near * total * total * total / (F.col("row_product") * F.col("side_product"))
    out = sums.withColumn("chi2", F.when((F.col("n_levels") == 2) & (F.col("n_labels") == 2), yates).otherwise(plain))
    enough = (F.col("n_levels") >= 2) & (F.col("n_labels") >= 2)
    dof = (F.col("n_levels") - F.lit(1)) * (F.col("n_labels") - F.lit(1))
    out = out.select("feature", F.when(enough, F.col("chi2")).alias("chi2"), F.when(enough, dof).alias("dof"),
                     "n_levels", F.when(~enough, F.lit("insufficient_levels")).alias("error"))
    return out.withColumn("p_value", p_value("chi2", F.col("chi2"), F.col("dof")))


def spearman(df: DataFrame, target: str = "Risk_Score", columns: Sequence[str] | None = None) -> DataFrame:
    """Spearman correlation with a target over pairwise complete rows."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    rows = df.select(num(df, target).alias("target"), *[num(df, c).alias(c) for c in columns])
    pairs = melt(rows, columns, ["target"]).filter(F.col("target").isNotNull())
    # Equal pairs share their ranks, so they are counted once and weighted.
    pairs = pairs.groupBy("feature", "value", "target").agg(F.count(F.lit(1)).alias("w"))

    def ranked(column: str, name: str) -> DataFrame:
        placed = prefix_sums(pairs, column, {"n": F.col("w")}, ["feature"])
        rank = F.col("n_before").cast("double") + (F.col("n").cast("double") + F.lit(1.0)) / F.lit(2.0)
        return placed.select("feature", column, rank.alias(name))

    both = pairs.join(ranked("value", "rx"), ["feature", "value"]).join(ranked("target", "ry"), ["feature", "target"])
    w = F.col("w").cast("double")
    sums = both.groupBy("feature").agg(
        F.sum("w").alias("n"), F.sum(w * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(w * F.col("rx") * F.col("rx")).alias("xx"), F.sum(w * F.col("ry") * F.col("ry")).alias("yy"))
    n = F.col("n").cast("double")
    centre = n * (n + F.lit(1.0)) * (n + F.lit(1.0)) / F.lit(4.0)
    rho = F.try_divide(F.col("xy") - centre, F.sqrt((F.col("xx") - centre) * (F.col("yy") - centre)))
    out = sums.select("feature", "n", F.when(n >= 3, clip(rho, -1.0, 1.0)).alias("correlation"),
                      F.when(n < 3, F.lit("insufficient_data")).alias("error"))
    r = F.col("correlation")
    out = out.withColumn("t", r * F.sqrt(F.try_divide(F.col("n") - F.lit(2.0), (F.lit(1.0) - r) * (F.lit(1.0) + r))))
    exact = F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(p_value("t", F.col("t"), F.col("n") - F.lit(2)))
    return out.select("feature", "correlation", exact.alias("p_value"),
                      (F.abs(r) > 0.9).alias("high_correlation"), "n", "error")


def ks_two_sample(df: DataFrame, score: str, label: str) -> DataFrame:
    """Largest gap between the score distributions of positives and negatives."""
    placed = _label_sums(df, score, label)
    gap = F.abs(F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total"))
                - F.try_divide(F.col("neg_before") + F.col("neg"), F.col("neg_total")))
    row = placed.agg(F.max(gap).alias("gap"), F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"))
    enough = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    row = row.select(F.when(enough, F.col("gap")).alias("statistic"), "n_pos", "n_neg",
                     F.when(~enough, F.lit("insufficient_group_data")).alias("error"))
    return row.withColumn("p_value", p_value("ks", F.col("statistic"), F.col("n_pos"), F.col("n_neg")))


def normality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Jarque-Bera on all rows; its tail is a plain exponential."""
    columns = list(columns or numeric_columns(df))
    long = melt(df, columns)
    moments = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k"))
    nan = F.lit(float("nan"))
    s, k = F.nullif(F.col("s"), nan), F.nullif(F.col("k"), nan)
    stat = F.col("n") / F.lit(6.0) * (s * s + k * k / F.lit(4.0))
    enough = F.col("n") >= 3
    out = moments.withColumns({"statistic": F.when(enough, stat),
                               "error": F.when(~enough, F.lit("insufficient_data"))})
    return out.select("feature", "statistic", F.exp(-F.col("statistic") / F.lit(2.0)).alias("pvalue"), "n", "error")


# --- policy evaluation -------------------------------------------------------

def _by_action(action: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), action.cast("int") + F.lit(1))


def evaluate_policy(df: DataFrame, action: str) -> DataFrame:
    """Reward of the taken actions, never under the minimum action of the score."""
    base = F.greatest(num(df, "Base_Price_USD", 1.0), F.lit(1.0))
    score = bound(num(df, "Risk_Score", 0.0), 0.0, 1.0)
    taken, least = F.col(action).cast("int"), px.minimum_action(score)
    rows = df.select(
        base.alias("base"), score.alias("score"), taken.alias("taken"), least.alias("least"),
        F.greatest(taken, least).alias("effective"), num(df, "Risk_Label", 0.0).cast("int").alias("label"))
    c = F.col
    loss = c("base") * (F.lit(0.05) + F.lit(0.35) * c("score")) * _by_action(c("effective"), K.EVAL_LOSS_MULTIPLIER)
    reward = (c("base") * _by_action(c("effective"), K.EVAL_PREMIUM_MULTIPLIER) - loss
              - _by_action(c("effective"), K.EVAL_INTERVENTION_COST)
              - F.when(c("taken") < c("least"), 250.0).otherwise(0.0)
              - F.when((c("taken") == 3) & (c("label") == 0), 90.0).otherwise(0.0)
              + F.when(c("effective") != 3, 2.0).otherwise(-5.0))
    rows = rows.withColumn("reward", reward / F.lit(100.0))
    counts = [F.count(F.when(c("taken") == i, F.lit(1))).alias(f"{name}_count")
              for i, name in enumerate(K.POLICY_ACTIONS)]
    row = rows.agg(F.avg("reward").alias("avg_reward"),
                   F.avg((c("taken") < c("least")).cast("double")).alias("violation_rate"), *counts)
    middle = scalar_row(grouped_quantiles(rows.select("reward"), "reward", {"m": 0.5})).getField("m")
    return row.withColumn("median_reward", middle)


def action_rewards(df: DataFrame) -> DataFrame:
    """Reward of each of the four actions and the best one (the mildest on ties)."""
    base = F.greatest(num(df, "Base_Price_USD", 1.0), F.lit(1.0))
    score = bound(num(df, "Risk_Score", 0.0), 0.0, 1.0)
    df = df.withColumns({"__base": base, "__score": score, "__least": px.minimum_action(score),
                         "__label": num(df, "Risk_Label", 0.0).cast("int")})
    out = {}
    for i, name in enumerate(K.POLICY_ACTIONS):
        loss = (F.col("__base") * (F.lit(0.05) + F.lit(0.35) * F.col("__score")) * F.lit(K.EVAL_LOSS_MULTIPLIER[i]))
        bonus = (18.0, 12.0, 0.0, 0.0)[i] + (1.5 if i != 3 else -4.0)
        reward = (F.col("__base") * F.lit(K.EVAL_PREMIUM_MULTIPLIER[i]) - loss
                  - F.lit(K.EVAL_INTERVENTION_COST[i]) + F.lit(bonus)
                  - F.when(F.lit(i) < F.col("__least"), 320.0).otherwise(0.0))
        if i == 3:
            reward = reward - F.when(F.col("__label") == 0, 90.0).otherwise(0.0)
        out[f"reward_{name}"] = reward / F.lit(100.0)
    df = df.withColumns(out)
    ranked = F.array(*[F.struct(F.col(f"reward_{n}").alias("r"), F.lit(-i).alias("i"))
                       for i, n in enumerate(K.POLICY_ACTIONS)])
    best = (-F.array_max(ranked).getField("i")).cast("int")
    return df.withColumn("best_action", best).drop("__base", "__score", "__least", "__label")

