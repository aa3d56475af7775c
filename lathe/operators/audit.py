"""Findings about a run: leakage, degenerate or skewed targets, width, and suspicious scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.stats import correlation
from lathe.operators.profile import quoted
from lathe.options import DEGENERATE_STD, LEAKAGE_CORRELATION, OVERFIT_AUDIT_GAP, OVERFIT_SUMMARY_GAP, PERFECT_R2, SKEW_FINDING
from lathe.sources.tables import numeric_columns

FINDING = "rule_order int, rule string, subject string, value double"


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """column, correlation: Pearson's r of each other numeric column with the target, null where either is constant."""
    columns = [c for c in numeric_columns(df) if c != target]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, correlation double")
    y = quoted(target)
    row = df.agg(*(correlation(quoted(c), y).alias(f"r{k}") for k, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"r{k}").alias("correlation")) for k, c in enumerate(columns)))
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def leaks(df: DataFrame, target: str) -> DataFrame:
    """Columns whose absolute correlation with the target exceeds 0.99."""
    return target_correlations(df, target).where(F.abs("correlation") > LEAKAGE_CORRELATION).select("column", F.abs("correlation").alias("correlation"))


def score_findings(metrics: DataFrame, leaking: bool) -> DataFrame:
    """Findings about each model's scores. metrics: model, r2, r2_train."""
    perfect = (F.col("r2") > PERFECT_R2) & (F.col("r2_train") > PERFECT_R2)
    gap = F.col("r2_train") - F.col("r2")
    def finding(order: int, rule: str, value: Column) -> Column:
        return F.struct(F.lit(order).alias("rule_order"), F.lit(rule).alias("rule"), value.alias("value"))

    fits = finding(5, "perfect_fit_with_leak" if leaking else "perfect_fit", F.col("r2"))
    found = F.array_compact(F.array(F.when(perfect, fits), F.when(~perfect & (gap > OVERFIT_AUDIT_GAP), finding(6, "overfit", gap)), F.when(F.col("r2") < 0, finding(7, "worse_than_mean", F.col("r2")))))
    known = metrics.where(F.col("r2").isNotNull() & F.col("r2_train").isNotNull())
    return known.select("model", F.explode(found).alias("f")).select("f.rule_order", "f.rule", F.col("model").alias("subject"), "f.value")


def findings(raw_train: DataFrame, target: str, metrics: DataFrame, *, std: float | None, skew: float | None, n_features: int, n_train: int, log_requested: bool) -> DataFrame:
    """rule_order, rule, subject, value: all findings, in the order of rules."""
    spark = raw_train.sparkSession
    leaking = leaks(raw_train, target)
    fixed = []
    if std is not None and std < DEGENERATE_STD:
        fixed.append((2, "degenerate_target", target, float(std)))
    if skew is not None and abs(skew) > SKEW_FINDING and not log_requested:
        fixed.append((3, "skewed_target", target, float(skew)))
    if n_features > n_train:
        fixed.append((4, "wide_data", target, float(n_features)))
    leak_rows = [(1, "leakage", r["column"], float(r["correlation"])) for r in leaking.collect()]  # a row a column at most
    return spark.createDataFrame([*leak_rows, *fixed], FINDING).unionByName(score_findings(metrics, bool(leak_rows)))


def overfit_flags(metrics: DataFrame) -> DataFrame:
    """model, gap, overfit and perfect, by the limits of the summary (not those of the audit)."""
    gap = F.col("r2_train") - F.col("r2")
    return metrics.select("model", gap.alias("gap"), (gap > OVERFIT_SUMMARY_GAP).alias("overfit"), ((F.col("r2") > PERFECT_R2) & (F.col("r2_train") > PERFECT_R2)).alias("perfect"))


def report(spark: SparkSession, found: DataFrame) -> str:
    """Findings as lines of text."""
    rows = found.orderBy("rule_order", F.desc("value"), "subject").collect()
    if not rows:
        return "The audit found nothing to warn of."
    said = {
        "leakage": "{s} correlates with the target at {v:.4f}: it most likely leaks it.",
        "degenerate_target": "the target {s} hardly varies (standard deviation {v:.2e}).",
        "skewed_target": "the target {s} is skewed ({v:+.2f}); a log transform may help.",
        "wide_data": "there are {v:.0f} features, more than training rows; prefer regularised models.",
        "perfect_fit_with_leak": "{s} fits both splits perfectly and a column leaks the target: trust neither.",
        "perfect_fit": "{s} fits both splits perfectly though no single column gives the target away; have a look at the data.",
        "overfit": "{s} overfits: its R2 falls by {v:.3f} from training to test rows.",
        "worse_than_mean": "{s} predicts worse than the mean (test R2 {v:.3f}).",
    }
    return "\n".join(["Findings:", *("- " + said[r["rule"]].format(s=r["subject"], v=r["value"]) for r in rows)])
