"""Portfolio bundle, live-ready frame and live table (Q1, Q2, Q6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fleetrisk import constants as K
from fleetrisk.operators import rollups
from fleetrisk.operators.cleaning import clean_portfolio
from fleetrisk.operators.joins import refresh_live_columns
from fleetrisk.operators.pricing import live_policy, live_risk_table, premium_schedule, profitability, quote
from fleetrisk.operators.scoring import live_risk_outputs

PRICING_SCORES = ("Risk_Score", "Calculated_Risk_Score", "Risk_Band", "Calculated_Risk_Band",
                  "Custom_Risk_Score", "Risk_Action")


def analysed_portfolio(df: DataFrame, as_of: datetime, rate: float = K.USD_TO_ZIG_RATE, source_name: str = "portfolio",
                       order_by: str | None = None, plates_known: bool = False, **model) -> DataFrame:
    """The scored, priced and re-scored portfolio that every table of the bundle reads.

    The pricing scores are dropped before the live scoring, so that the live score is not
    smoothed against a score made for another purpose.
    """
    quoted = quote(clean_portfolio(df, order_by, plates_known), as_of, **model)
    analysed = profitability(live_risk_outputs(quoted.drop(*PRICING_SCORES)), rate)
    return analysed.withColumns({"Analysis_Source": F.lit(source_name),
                                 "Analysis_Generated_At": F.lit(as_of.isoformat())})


def analyse_portfolio(df: DataFrame, as_of: datetime, rate: float = K.USD_TO_ZIG_RATE,
                      source_name: str = "portfolio", persist: bool = True, **options) -> dict[str, DataFrame]:
    """Q1: the analysis bundle as lazy frames over one shared scored frame.

    With ``persist`` the shared frame is kept in memory and on disk; call ``unpersist`` on
    ``bundle["analysis"]`` when done.
    """
    analysed = analysed_portfolio(df, as_of, rate, source_name, **options)
    if persist:
        analysed = analysed.persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "analysis": analysed,
        "premium_schedule": premium_schedule(analysed, rate),
        "risk_summary": rollups.band_summary(analysed),
        "city_summary": rollups.city_summary(analysed),
        "recommendations": rollups.recommendations(analysed, 50),
        "action_summary": rollups.action_counts(analysed),
        "summary": rollups.bundle_summary(analysed, source_name, trained_model="model" in options),
    }


def live_ready(base: DataFrame, live: DataFrame | None, order: Sequence[str | Column] | None = None,
               as_of: datetime | None = None, rate: float = K.USD_TO_ZIG_RATE) -> DataFrame:
    """Q2: refresh the live columns, then score, set the policy and price again."""
    frame = base if live is None else refresh_live_columns(base, live, order)
    return profitability(live_policy(live_risk_outputs(frame), as_of), rate)


def live_table(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Q6: the live vehicle risk table with policy fields."""
    return live_risk_table(df, as_of)


QUOTE_FIELDS = (
    ("LightGBM_Risk_Score", DoubleType()), ("Risk_Score", DoubleType()), ("Calculated_Risk_Score", DoubleType()),
    ("Risk_Band", StringType()), ("PPO_Action", StringType()), ("Premium_Multiplier", DoubleType()),
    ("Risk_Based_Daily_Premium_USD", DoubleType()), ("Risk_Based_Monthly_Premium_USD", DoubleType()),
    ("Policy_Adjusted_Daily_Premium_USD", DoubleType()), ("Policy_Adjusted_Monthly_Premium_USD", DoubleType()),
    ("Expected_Claim_USD", DoubleType()), ("Decision_Status", StringType()), ("Decision_Timestamp", StringType()),
)


def quote_schema(schema: StructType) -> StructType:
    """The input schema with the quote fields that it lacks."""
    have = set(schema.fieldNames())
    return StructType(list(schema.fields) + [StructField(n, t, True) for n, t in QUOTE_FIELDS if n not in have])


def map_quotes(df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Extension point for a user's own model, applied to Arrow batches.

    ``make_scorer`` runs once per task, so a model is loaded once and not per batch.
    """
    schema = quote_schema(df.schema)
    names = schema.fieldNames()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scored = scorer(batch)
            yield pd.DataFrame({
                name: scored[name].to_numpy() if name in scored else [None] * len(scored) for name in names})

    return df.mapInPandas(score, schema)
