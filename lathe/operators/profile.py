"""Column and target profiles.

Moments and exact distinct counts are two aggregates: in one, the other buffers would ride through the
distinct ones' expanded rows. Each reads the table once, whatever the number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.stats import sample_skewness
from lathe.options import DATETIME_SHARE, HIGH_CARDINALITY, ID_NAME_HINTS, LOW_VARIANCE_DISTINCT, MISSING_PERCENT, SKEW_ADVICE
from lathe.sources.tables import is_number

#: Formats tried, in this order, on a column's first value; the column then is parsed by that one.
DATETIME_FORMATS = (
    ("iso", r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("yyyy", r"^\d{4}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("MMM d yyyy", r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),
)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_datetime(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def as_timestamp(c: Column, kind: T.DataType, fmt: str | None) -> Column:
    """A value as a timestamp without zone; null for what doesn't parse."""
    if is_datetime(kind):
        return c.cast("timestamp_ntz")
    if fmt is None:
        return F.lit(None).cast("timestamp_ntz")
    if fmt == "iso":
        zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & c.rlike(r"\d:\d")
        return F.when(c.rlike(DATETIME_FORMATS[0][1]), F.when(zoned, F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")).otherwise(c.try_cast("timestamp_ntz")))
    return F.when(c.rlike(dict(DATETIME_FORMATS)[fmt]), F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"))


def format_of(values: list[str | None]) -> str | None:
    """The first format that the first known value has."""
    import re

    first = next((v for v in values if v is not None), None)
    return None if first is None else next((name for name, pattern in DATETIME_FORMATS if re.match(pattern, first)), None)


def first_values(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    if not columns:
        return {}
    row = df.agg(*(F.first(quoted(c), ignorenulls=True).alias(f"f{k}") for k, c in enumerate(columns))).first()
    return {c: row[f"f{k}"] for k, c in enumerate(columns)}


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """One row: n_rows, n_cols, mean, std, min, max, skew, missing of the target."""
    y = quoted(target).cast("double")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        sample_skewness(y).alias("skew"),
        F.count_if(y.isNull()).alias("missing"),
    )


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: position, name, missing, missing_pct, unique, mean, std, minimum, maximum and
    fractions (how many values aren't whole; numbers only)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    moments, distinct = [F.count("*").alias("n")], []
    for k, c in enumerate(columns):
        x = quoted(c)
        number = x.cast("double") if is_number(kinds[c]) else F.lit(None).cast("double")
        moments += [
            F.count(x).alias(f"known{k}"),
            F.avg(number).alias(f"mean{k}"),
            F.stddev_samp(number).alias(f"std{k}"),
            F.min(number).alias(f"min{k}"),
            F.max(number).alias(f"max{k}"),
            F.count_if(number != F.floor(number)).alias(f"frac{k}"),
        ]
        distinct.append(F.count_distinct(x).alias(f"unique{k}"))
    if not columns:
        return df.sparkSession.createDataFrame([], _STATS)
    # two one-row tables side by side
    both = df.agg(*moments).withColumn("_one", F.lit(1)).join(df.agg(*distinct).withColumn("_one", F.lit(1)), "_one")
    rows = [
        F.struct(
            F.lit(k).alias("position"),
            F.lit(c).alias("name"),
            (F.col("n") - F.col(f"known{k}")).alias("missing"),
            F.round((F.col("n") - F.col(f"known{k}")) * 100 / F.nullif(F.col("n").cast("double"), F.lit(0.0)), 2).alias("missing_pct"),
            F.col(f"unique{k}").alias("unique"),
            F.col(f"mean{k}").alias("mean"),
            F.col(f"std{k}").alias("std"),
            F.col(f"min{k}").alias("minimum"),
            F.col(f"max{k}").alias("maximum"),
            F.col(f"frac{k}").alias("fractions"),
        )
        for k, c in enumerate(columns)
    ]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_STATS = "position int, name string, missing long, missing_pct double, unique long, mean double, std double, minimum double, maximum double, fractions long"


def parse_shares(df: DataFrame, columns: dict[str, str | None]) -> dict[str, float]:
    """For string columns and their formats: parsed values by known ones."""
    kept = {c: f for c, f in columns.items() if f}
    if not kept:
        return dict.fromkeys(columns, 0.0)
    row = df.agg(*(_share(quoted(c), f).alias(f"s{k}") for k, (c, f) in enumerate(kept.items()))).first()
    return dict.fromkeys(columns, 0.0) | {c: row[f"s{k}"] for k, c in enumerate(kept)}


def _share(x: Column, fmt: str) -> Column:
    return F.count(as_timestamp(x, T.StringType(), fmt)) / F.greatest(F.count(x), F.lit(1)).cast("double")


def has_id_name(name: str) -> bool:
    return any(hint in name.lower() for hint in ID_NAME_HINTS)


def monotone(df: DataFrame, columns: list[str], order: list[str]) -> dict[str, bool]:
    """Whether each column's values rise or fall throughout, in row order; nulls break the order.

    Rows are sorted once over range partitions. Within each, neighbours are compared; across
    partitions, only their first and last values are, in the order of partitions."""
    if not columns:
        return {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [quoted(c) for c in order]
    values = [quoted(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)]
    rows = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), *values)
    by = [f"k{i}" for i in range(len(keys))]
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("at"))
    part = F.shiftright("at", 33)
    w = Window.partitionBy(part).orderBy("at")
    steps = rows.select(part.alias("part"), "at", *(F.col(f"v{k}") for k in range(len(columns))), *((F.col(f"v{k}") - F.lag(f"v{k}").over(w)).alias(f"d{k}") for k in range(len(columns))))
    aggregates = []
    for k in range(len(columns)):
        aggregates += [F.count_if(F.col(f"d{k}") < 0).alias(f"down{k}"), F.count_if(F.col(f"d{k}") > 0).alias(f"up{k}"), F.count_if(F.col(f"v{k}").isNull()).alias(f"null{k}"), F.min_by(f"v{k}", "at").alias(f"first{k}"), F.max_by(f"v{k}", "at").alias(f"last{k}")]
    parts = steps.groupBy("part").agg(*aggregates).orderBy("part").collect()  # a row for each partition
    out = {}
    for k, c in enumerate(columns):
        if any(p[f"null{k}"] for p in parts):
            out[c] = False
            continue
        jumps = [b[f"first{k}"] - a[f"last{k}"] for a, b in zip(parts, parts[1:])]
        up = not any(p[f"down{k}"] for p in parts) and all(j >= 0 for j in jumps)
        down = not any(p[f"up{k}"] for p in parts) and all(j <= 0 for j in jumps)
        out[c] = up or down
    return out


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    kind: str  # id_like, numeric, datetime or categorical
    dtype: str
    missing: int
    missing_pct: float
    unique: int
    mean: float | None = None
    std: float | None = None
    high_cardinality: bool = False
    low_variance: bool = False
    datetime_format: str | None = None


@dataclass(frozen=True)
class Profile:
    target: str
    n_rows: int
    n_cols: int
    stats: dict[str, float | None]
    columns: list[ColumnProfile] = field(default_factory=list)
    missing_total: int = 0

    def named(self, kind: str) -> list[str]:
        return [c.name for c in self.columns if c.kind == kind]

    @property
    def high_cardinality(self) -> list[str]:
        return [c.name for c in self.columns if c.high_cardinality and c.kind == "categorical"]

    @property
    def low_variance(self) -> list[str]:
        return [c.name for c in self.columns if c.low_variance]

    def missing_most(self, top: int = 5) -> list[tuple[str, float]]:
        over = [(c.name, c.missing_pct) for c in self.columns if c.missing_pct > MISSING_PERCENT]
        return sorted(over, key=lambda x: -x[1])[:top]

    @property
    def skewed(self) -> bool:
        return abs(self.stats["skew"] or 0.0) > SKEW_ADVICE

    def without(self, columns: list[str]) -> Profile:
        """What profiling again without these columns gives, without reading anything."""
        gone = set(columns)
        lost = sum(c.missing for c in self.columns if c.name in gone)
        return Profile(self.target, self.n_rows, self.n_cols - len(gone), self.stats, [c for c in self.columns if c.name not in gone], self.missing_total - lost)


def profile(df: DataFrame, target: str, order: list[str] | None = None) -> Profile:
    """Profiles all columns. order: what defines row order, for id detection by values (default: as read)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in df.columns if c != target]
    t = target_stats(df, target).first()
    stats = {r["name"]: r for r in column_stats(df, columns).collect()}
    strings = [c for c in columns if isinstance(kinds[c], T.StringType) and not has_id_name(c)]
    formats = {c: format_of([v]) for c, v in first_values(df, strings).items()}
    shares = parse_shares(df, formats)
    maybe = [c for c in columns if is_number(kinds[c]) and not has_id_name(c) and stats[c]["unique"] == t["n_rows"] - stats[c]["missing"] and not stats[c]["missing"] and not stats[c]["fractions"]]
    if maybe:
        keyed = df if order else df.withColumn("_as_read", F.monotonically_increasing_id())
        rising = monotone(keyed, maybe, order or ["_as_read"])
    else:
        rising = {}
    out = []
    for c in columns:
        s = stats[c]
        common = {"name": c, "dtype": kinds[c].simpleString(), "missing": s["missing"], "missing_pct": s["missing_pct"] or 0.0, "unique": s["unique"]}
        low = s["unique"] <= LOW_VARIANCE_DISTINCT
        if has_id_name(c) or rising.get(c, False):
            out.append(ColumnProfile(kind="id_like", **common))
        elif is_number(kinds[c]):
            out.append(ColumnProfile(kind="numeric", mean=s["mean"], std=s["std"], low_variance=low, **common))
        elif is_datetime(kinds[c]) or shares.get(c, 0.0) > DATETIME_SHARE:
            out.append(ColumnProfile(kind="datetime", low_variance=low, datetime_format=formats.get(c), **common))
        else:
            out.append(ColumnProfile(kind="categorical", high_cardinality=s["unique"] > HIGH_CARDINALITY, low_variance=low, **common))
    total = t["missing"] + sum(c.missing for c in out)
    return Profile(target, t["n_rows"], t["n_cols"], {k: t[k] for k in ("mean", "std", "min", "max", "skew", "missing")}, out, total)


def profile_table(df: DataFrame, p: Profile) -> DataFrame:
    """A profile as rows: column, kind, dtype, missing, missing_pct, unique, high_cardinality, low_variance."""
    rows = [(k, c.name, c.kind, c.dtype, c.missing, float(c.missing_pct), c.unique, c.high_cardinality, c.low_variance) for k, c in enumerate(p.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, kind string, dtype string, missing long, missing_pct double, unique long, high_cardinality boolean, low_variance boolean")
