"""Cost of calls by model and tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# US dollars for a million tokens, in and out.
RATES = (
    ("gpt-4.1", 2.00, 8.00),
    ("gpt-4.1-mini", 0.40, 1.60),
    ("gpt-4.1-nano", 0.10, 0.40),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
)
NO_CALLS = "No API calls made yet."


@F.pandas_udf(T.StringType())
def _dollars(value: pd.Series) -> pd.Series:
    """Six decimals of the double's exact value, which no built-in function rounds alike."""
    return value.map(lambda x: None if pd.isna(x) else f"{x:.6f}")


def _grouped(value: Column) -> Column:
    return F.format_number(value, 0)


def call_cost(calls: DataFrame) -> DataFrame:
    """``calls`` (model, input_tokens, output_tokens) with token and dollar columns; an unknown model costs nothing.

    The rates are five rows and are broadcast.
    """
    rates = calls.sparkSession.createDataFrame(RATES, "model string, input_rate double, output_rate double")
    joined = calls.join(F.broadcast(rates), "model", "left")
    million = F.lit(1e6)
    paid_in = (F.col("input_tokens") / million) * F.coalesce("input_rate", F.lit(0.0))
    paid_out = (F.col("output_tokens") / million) * F.coalesce("output_rate", F.lit(0.0))
    tokens = F.col("input_tokens") + F.col("output_tokens")
    costed = joined.withColumns({"total_tokens": tokens, "input_cost_usd": paid_in, "output_cost_usd": paid_out, "total_cost_usd": paid_in + paid_out}).drop("input_rate", "output_rate")
    return costed.withColumn("formatted", F.concat(F.lit("🪙 **This call:** "), _grouped(F.col("total_tokens")), F.lit(" tokens ($"), _dollars(F.col("total_cost_usd")), F.lit(")")))


def in_order(value: Column, order: Column) -> Column:
    """Aggregate: the sum of ``value`` in ``order``, so that it is the same to the last bit however rows are dealt out.

    A group's numbers are gathered in one row and folded; nulls are passed over.
    """
    sorted_values = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("order"), value.alias("value")))))
    return F.aggregate(sorted_values, F.lit(0.0), lambda total, x: total + x["value"])


def session_cost(calls: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Calls, tokens and dollars by session; with ``sessions`` (session_id) those without calls too.

    Dollars are summed in the order of call_seq, or of the calls' own values where
    there is no such column.
    """
    costed = call_cost(calls)
    order = F.struct(*[c for c in ("call_seq", "model", "input_tokens", "output_tokens") if c in calls.columns])
    summed = costed.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("total_tokens").alias("total_tokens"), in_order(F.col("total_cost_usd"), order).alias("total_cost_usd"))
    if sessions is not None:
        summed = sessions.select("session_id").distinct().join(summed, "session_id", "left").fillna(0, ["n_calls", "total_tokens"]).fillna(0.0, ["total_cost_usd"])
    text = F.concat(F.lit("📊 **Session total:** "), F.col("n_calls"), F.lit(" call(s) | "), _grouped(F.col("total_tokens")), F.lit(" tokens | $"), _dollars(F.col("total_cost_usd")), F.lit(" USD"))
    return summed.withColumn("formatted", F.when(F.col("n_calls") > 0, text).otherwise(F.lit(NO_CALLS)))
