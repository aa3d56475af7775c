"""Feature engineering: dates to parts, imputation, scaling, one-hot and frequency encoding.

Statistics are fitted on the training rows by aggregates; what applies them is a projection, and a left
join for each frequency-encoded column. The flat columns are for queries, the vector for models.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.operators.ordering import order_rows
from lathe.operators.profile import as_timestamp, quoted
from lathe.options import HIGH_CARDINALITY, LOW_VARIANCE_DISTINCT
from lathe.sources.tables import is_number

FEATURES, LABEL = "features", "label"
#: Up to so many rows exact medians come from one aggregate, beyond from a distributed sort of the rows around the middle.
AGGREGATE_MEDIAN_ROWS = 5_000_000
#: Half the share of ranks between the two quantiles within which a median is looked for first.
MEDIAN_SPREAD = 0.002
#: Rows that settle most columns' questions of "more distinct values than this?".
FIRST_ROWS = 20_000
PARTS = ("year", "month", "day", "weekday")


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    y = quoted(target).cast("double")
    return df.where(y.isNotNull() & ~F.isnan(y))


def check_target(target: str, train: DataFrame, validation: DataFrame | None = None, test: DataFrame | None = None) -> None:
    if target not in train.columns:
        raise ValueError(f"the training data has no column {target!r}")
    if not is_number(train.schema[target].dataType):
        raise ValueError(f"{target!r} isn't numeric; only regression is done here")
    for name, df in (("validation", validation), ("test", test)):
        if df is not None and target not in df.columns:
            raise ValueError(f"the {name} data has no column {target!r}")


def columns_with_hours(df: DataFrame, dates: dict[str, str | None]) -> list[str]:
    """Date columns of which some value has an hour other than 0."""
    if not dates:
        return []
    row = df.agg(*(F.max(F.hour(as_timestamp(quoted(c), df.schema[c].dataType, f))).alias(f"h{k}") for k, (c, f) in enumerate(dates.items()))).first()
    return [c for k, c in enumerate(dates) if (row[f"h{k}"] or 0) > 0]


def date_parts(df: DataFrame, dates: dict[str, str | None], with_hour: list[str]) -> DataFrame:
    """df with each date column replaced by its year, month, day, weekday (Monday is 0) and, for those in
    with_hour, hour. Columns that df lacks are passed over."""
    out = df
    for c, fmt in dates.items():
        if c not in df.columns:
            continue
        t = as_timestamp(quoted(c), df.schema[c].dataType, fmt)
        parts = {f"{c}_year": F.year(t), f"{c}_month": F.month(t), f"{c}_day": F.dayofmonth(t), f"{c}_weekday": F.weekday(t)}
        if c in with_hour:
            parts[f"{c}_hour"] = F.hour(t)
        out = out.withColumns(parts).drop(c)
    return out


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*(F.count_distinct(quoted(c)).alias(f"d{k}") for k, c in enumerate(columns))).first()
    return {c: row[f"d{k}"] for k, c in enumerate(columns)}


def with_more_than(df: DataFrame, columns: list[str], bound: int) -> set[str]:
    """Columns with more than `bound` distinct known values. Those that show them in the first rows are
    settled by these; only the others are counted over all rows."""
    first = distinct_counts(df.select(*map(quoted, columns)).limit(FIRST_ROWS), columns) if columns else {}
    settled = {c for c, n in first.items() if n > bound}
    return settled | {c for c, n in distinct_counts(df, [c for c in columns if c not in settled]).items() if n > bound}


def constant_columns(df: DataFrame, keep: set[str]) -> list[str]:
    """Columns outside `keep` with at most one known value."""
    columns = [c for c in df.columns if c not in keep]
    varied = with_more_than(df, columns, LOW_VARIANCE_DISTINCT)
    return [c for c in columns if c not in varied]


@dataclass(frozen=True)
class Classes:
    numeric: list[str]
    low_cardinality: list[str]
    high_cardinality: list[str]


def classify(train: DataFrame, columns: list[str]) -> Classes:
    """Numbers; other columns by whether they have more than 20 distinct values in the training rows."""
    kinds = {f.name: f.dataType for f in train.schema.fields}
    numeric = [c for c in columns if is_number(kinds[c])]
    others = [c for c in columns if c not in numeric]
    many = with_more_than(train, others, HIGH_CARDINALITY)
    return Classes(numeric, [c for c in others if c not in many], [c for c in others if c in many])


def exact_medians(df: DataFrame, columns: list[str], n: int | None = None) -> dict[str, float | None]:
    if not columns:
        return {}
    n = df.count() if n is None else n
    if n <= AGGREGATE_MEDIAN_ROWS:
        row = df.agg(*(F.percentile(quoted(c).cast("double"), 0.5).alias(f"m{k}") for k, c in enumerate(columns))).first()
        return {c: row[f"m{k}"] for k, c in enumerate(columns)}
    # Sketches of all columns guess a narrow range around each middle, and counts prove it or not; only its rows are sorted.
    values = [quoted(c).cast("double") for c in columns]
    sides = F.array(F.lit(0.5 - MEDIAN_SPREAD), F.lit(0.5 + MEDIAN_SPREAD))
    guess = df.agg(*(f(x).alias(f"{name}{k}") for k, x in enumerate(values) for name, f in (("n", F.count), ("q", lambda x: F.percentile_approx(x, sides, F.lit(5_000)))))).first()
    known = [k for k in range(len(columns)) if guess[f"n{k}"]]
    ranges = {k: guess[f"q{k}"] for k in known}
    sure = df.agg(F.count("*"), *(F.count_if(c).alias(f"{name}{k}") for k, (a, b) in ranges.items() for name, c in (("u", values[k] < a), ("b", values[k].between(a, b))))).first()
    out: dict[str, float | None] = dict.fromkeys(columns)
    for k, (a, b) in ranges.items():
        m, under, between = guess[f"n{k}"], sure[f"u{k}"], sure[f"b{k}"]
        wanted, rows = ((m - 1) // 2, m // 2), df.where(values[k].isNotNull())
        if under <= wanted[0] and wanted[1] < under + between:
            if a == b:
                out[columns[k]] = a
                continue
            wanted, rows = (wanted[0] - under, wanted[1] - under), rows.where(values[k].between(a, b))
        found = order_rows(rows, [values[k]], list(wanted))
        out[columns[k]] = sum(found[i][0] for i in wanted) / 2
    return out


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent known value of each column, the least of those that are equally frequent."""
    if not columns:
        return {}
    row = df.agg(*(F.mode(quoted(c), True).alias(f"m{k}") for k, c in enumerate(columns))).first()
    return {c: row[f"m{k}"] for k, c in enumerate(columns)}


def frequencies(train: DataFrame, column: str) -> DataFrame:
    """value, share: each known value's share of the known ones in the training rows."""
    counts = train.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("value")).count()
    total = train.agg(F.count(quoted(column)).cast("double").alias("n")).first()["n"]
    return counts.select("value", (F.col("count") / F.lit(total)).alias("share"))


def frequency_encode(df: DataFrame, column: str, shares: DataFrame) -> DataFrame:
    """df with `column` replaced by its values' shares; unknown and new values get 0."""
    names = df.columns
    lookup = shares.select(F.col("value").alias("_value"), F.col("share").alias("_share"))
    joined = df.join(lookup, quoted(column) == F.col("_value"), "left")
    return joined.select(*(F.coalesce("_share", F.lit(0.0)).alias(c) if c == column else quoted(c) for c in names))


@dataclass
class FeatureModel:
    """Fitted on training rows; `transform` gives `features` (vector) and the flat columns they come from."""

    target: str
    numeric: list[str]
    frequency: dict[str, DataFrame]
    one_hot: dict[str, list[str]]  # sorted values
    medians: dict[str, float]
    modes: dict[str, str | None]
    means: dict[str, float]
    stds: dict[str, float]
    names: list[str] = field(default_factory=list)

    def flat(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep's columns, then f0, f1, ... as doubles in the order of `names`."""
        for c, shares in self.frequency.items():
            df = frequency_encode(df, c, shares)
        out: list[Column] = []
        for c in (*self.numeric, *self.frequency):
            x = F.coalesce(quoted(c).cast("double"), F.lit(self.medians[c]))
            out.append((x - self.means[c]) / (self.stds[c] or 1.0))
        for c, values in self.one_hot.items():
            x = F.coalesce(quoted(c).cast("string"), F.lit(self.modes[c]))
            out += [F.coalesce((x == v).cast("double"), F.lit(0.0)) for v in values]
        return df.select(*(quoted(c) for c in keep), *(c.cast("double").alias(f"f{k}") for k, c in enumerate(out)))

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """keep's columns, `label` (if df has the target) and `features`."""
        keep = keep or []
        has_target = self.target in df.columns
        labelled = df.withColumn("_label", quoted(self.target).cast("double")) if has_target else df
        flat = self.flat(labelled, [*keep, *(["_label"] if has_target else [])])
        inputs = [f"f{k}" for k in range(len(self.names))]
        assembled = VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(flat)
        return assembled.select(*(quoted(c) for c in keep), *([F.col("_label").alias(LABEL)] if has_target else []), FEATURES)


def _spread(std: float, mean: float, n: int) -> float:
    """A standard deviation, or 0 if it is no more than rounding makes of equal values."""
    eps = 2.220446049250313e-16
    return 0.0 if std**2 <= n * eps * std**2 + (n * mean * eps) ** 2 else std


def fit_features(train: DataFrame, target: str, columns: list[str]) -> FeatureModel:
    c = classify(train, columns)
    n = train.count()
    medians = exact_medians(train, c.numeric, n)
    empty = [x for x in c.numeric if medians[x] is None]  # nothing known: no feature
    numeric = [x for x in c.numeric if x not in empty]
    frequency = {x: frequencies(train, x) for x in c.high_cardinality}
    filled = {x: F.coalesce(quoted(x).cast("double"), F.lit(medians[x])) for x in numeric}
    means, stds = {}, {}
    if numeric:
        row = train.agg(*(f(v).alias(f"{name}{k}") for k, v in enumerate(filled.values()) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        for k, x in enumerate(numeric):
            means[x], stds[x] = row[f"m{k}"], _spread(row[f"s{k}"], row[f"m{k}"], n)
    for x, shares in frequency.items():
        known = train.agg(F.count(quoted(x)).alias("n")).first()["n"]
        # a value occurs share * known times; unknown values count as 0
        mean = (shares.agg(F.sum(F.col("share") ** 2).alias("m")).first()["m"] or 0.0) * known / n if n else 0.0
        around = shares.agg(F.sum(F.col("share") * (F.col("share") - mean) ** 2).alias("v")).first()["v"] or 0.0
        std = ((around * known + (n - known) * mean**2) / n) ** 0.5 if n else 0.0
        medians[x], means[x], stds[x] = 0.0, mean, _spread(std, mean, n)
    low = c.low_cardinality
    top = {k: None if v is None else str(v) for k, v in modes(train, low).items()}
    values: dict[str, list[str]] = {}
    if low:
        row = train.agg(*(F.array_sort(F.collect_set(quoted(x).cast("string"))).alias(f"v{k}") for k, x in enumerate(low))).first()
        values = {x: list(row[f"v{k}"]) for k, x in enumerate(low)}  # at most 20 each
    names = [*numeric, *frequency, *(f"{x}_{v}" for x in low for v in values[x])]
    return FeatureModel(target, numeric, frequency, values, medians, top, means, stds, names)


def can_log(target: str, *frames: DataFrame | None) -> bool:
    """Whether no target value of any frame is negative."""
    for df in frames:
        if df is not None:
            low = df.agg(F.min(quoted(target).cast("double")).alias("low")).first()["low"]
            if low is not None and low < 0:
                return False
    return True


def is_string(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)
