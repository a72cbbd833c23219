"""Per-key reports composed from the operators.

The rollups they share are built once; ``insight_report`` keeps one daily
rollup so the summary, shares, trend, forecast, goal and alert parts read it
instead of rescanning the ledger (the reference reads the whole ledger ten
times per page view).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import keys
from tallyspark.operators.ordered import forecast_next, trend, weekly_alert
from tallyspark.operators.rollups import goal_progress, summary_stats
from tallyspark.schema import UNDERREPRESENTED_SHARE

# ---- Fixed message texts (must read as the reference's) ----
MSG_OVERSPENT = "⚠ You spent more than you earned."
MSG_SAVED = "✅ You saved money overall."
MSG_TREND_UP = "📈 Spending has increased over the last months."
MSG_TREND_DOWN = "📉 Spending has decreased over the last months."
MSG_TREND_MIXED = "➡️ Spending shows mixed patterns recently."
MSG_TREND_NONE = "Not enough data for trend detection."
MSG_TREND_SINGLE = "Only one month of data: {month} total spending was ${amount}."
MSG_WEEK_HIGH = "⚠️ This week's expenses are over 30% higher than your usual average."
MSG_WEEK_OK = "✅ This week's expenses are within your usual range."
MSG_ANOMALY = "⚠️ On {date}, unusual spending detected: ${amount} in {category}."


def trend_message(tr: str = "trend", month: str = "last_month", total: str = "last_total") -> F.Column:
    single = F.concat(F.lit("Only one month of data: "), F.col(month), F.lit(" total spending was $"),
                      F.col(total).cast("decimal(28,2)").cast("string"), F.lit("."))
    return (F.when(F.col(tr) == "up", F.lit(MSG_TREND_UP))
            .when(F.col(tr) == "down", F.lit(MSG_TREND_DOWN))
            .when(F.col(tr) == "mixed", F.lit(MSG_TREND_MIXED))
            .when(F.col(tr) == "single", single)
            .otherwise(F.lit(MSG_TREND_NONE)))


def insight_list(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """overspent/saved verdict and the trend message per key."""
    k = keys(by)
    s = summary_stats(df, by)
    t = trend(df, by)
    verdict = F.when(F.col("expense") > F.col("income"), F.lit(MSG_OVERSPENT)).otherwise(F.lit(MSG_SAVED))
    j = s.join(t, on=k, how="left") if k else s.withColumn("_k", F.lit(0)).join(
        t.withColumn("_k", F.lit(0)), "_k", "left")
    return j.select(*k, verdict.alias("verdict"), trend_message().alias("trend_message"))


def insight_messages(df: DataFrame, by: Sequence[str] | None = None, anomalies: DataFrame | None = None,
                     advice: DataFrame | None = None) -> DataFrame:
    """H14 in full: the per-key message list, long form ``(key, section, sort_key, message)``.

    Sections in reading order: 0 verdict, 1 anomaly messages (by date and id),
    2 trend, 3 budget advice.  One row per message and no per-key collect or
    window, so a key with many anomalies is spread like any other rows; the
    reader orders by ``(section, sort_key)``.
    """
    k = keys(by)
    head = insight_list(df, by)
    parts = [head.select(*k, F.lit(0).alias("section"), F.lit("").alias("sort_key"),
                         F.col("verdict").alias("message")),
             head.select(*k, F.lit(2).alias("section"), F.lit("").alias("sort_key"),
                         F.col("trend_message").alias("message"))]
    if anomalies is not None:
        from tallyspark.ml.anomaly import anomaly_messages
        msgs = anomaly_messages(anomalies).join(anomalies.select("tx_id", "tx_date"), "tx_id")
        parts.append(msgs.select(*k, F.lit(1).alias("section"),
                                 F.concat_ws("|", F.date_format("tx_date", "yyyy-MM-dd"), F.col("tx_id"))
                                 .alias("sort_key"), "message"))
    if advice is not None:
        parts.append(advice.select(*k, F.lit(3).alias("section"), F.explode(
            F.arrays_zip(F.sequence(F.lit(1), F.size("recommendations")), F.col("recommendations"))).alias("r"))
            .select(*k, "section", F.format_string("%03d", F.col("r").getField("0")).alias("sort_key"),
                    F.col("r").getField("recommendations").alias("message")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def insight_report(df: DataFrame, by: Sequence[str] | None = None,
                   anomalies: DataFrame | None = None, advice: DataFrame | None = None) -> DataFrame:
    """One wide row per key: checks, stats, trend, forecast, goal, alert, anomalies, advice.

    ``anomalies`` (rows flagged by the anomaly model, with the key columns)
    and ``advice`` (key -> array of texts) are optional model outputs.
    """
    k = keys(by)
    if not k:
        df, k = df.withColumn("_all", F.lit(0)), ["_all"]
    # one shared daily rollup (key, date, type, category): every part below is a
    # sum over it, so the ledger is scanned once and what is kept is rollup-sized;
    # it is dealt by key once, so the parts and their joins find its rows together
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = (df.groupBy(*k, "tx_date", "t_type", "category")
            .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
            .repartition(n_parts, *k).persist(StorageLevel.MEMORY_AND_DISK))
    s = summary_stats(base, k)
    shares = (base.filter(F.col("category").isNotNull()).groupBy(*k, "category").agg(F.sum("n").alias("n"))
              .withColumn("share", F.col("n").cast("double")
                          / F.sum("n").over(Window.partitionBy(*k)).cast("double"))
              .groupBy(*k).agg((F.min("share") < F.lit(UNDERREPRESENTED_SHARE)).alias("underrepresented")))
    parts = [
        shares,
        trend(base, k).select(*k, "trend", trend_message().alias("trend_message")),
        forecast_next(base, k).select(*k, F.col("last_total").alias("last_month_total"), "forecast_next_month"),
        goal_progress(base, k).select(*k, "progress_pct", "progress"),
        weekly_alert(base, k).select(*k, F.when(F.col("alert"), F.lit(MSG_WEEK_HIGH))
                                     .when(~F.col("alert"), F.lit(MSG_WEEK_OK)).alias("alert_message")),
    ]
    out = s
    for p in parts:
        out = out.join(p, on=k, how="left")
    if anomalies is not None:
        msgs = anomalies.groupBy(*k).agg(F.count(F.lit(1)).alias("n_anomalies"))
        out = out.join(msgs, on=k, how="left").withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0)))
    if advice is not None:
        out = out.join(advice, on=k, how="left")
    return out.drop("_all") if "_all" in out.columns else out
