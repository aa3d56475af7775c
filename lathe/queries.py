"""The library's operators as queries on the driver's tables, each with SQL that gives the same rows.

Floats are rounded on both sides. Nulls, which the tables lack, are injected alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.stats import normal_quantile_sql, order_median_sql
from lathe.operators import audit, charts, features, grams, models, profile, splits, training
from lathe.options import Options
from lathe.plans.analysis import prepare
from lathe.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read_parquet(spark, f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Adding zero makes a negative zero a plain one, here and in the SQL."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + 0.0 for c in columns})


# ---- sources


@query("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _(spark, d):
    return tables.preview(load(spark, d, "orders"), ["o_orderkey"])


@query("shapes", "SELECT 'train' AS split, count(*) AS n_rows, 6::BIGINT AS n_cols FROM part UNION ALL SELECT 'test', count(*), 5::BIGINT FROM customer")
def _(spark, d):
    return tables.shapes(tables.Dataset(load(spark, d, "part"), test=load(spark, d, "customer")))


_RAW = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE c_acctbal::VARCHAR END AS bal, CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'False' END AS flag, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS nation FROM customer"


@query(
    "inferred_types",
    f"SELECT count(bal::DOUBLE) AS n_bal, round(sum(bal::DOUBLE), 2) AS sum_bal, count_if(flag::BOOLEAN)::BIGINT AS n_true, sum(nation::BIGINT)::BIGINT AS sum_nation, 'bigint,double,boolean,bigint' AS kinds FROM (SELECT c_custkey, nullif(bal, 'NA') AS bal, flag, nullif(nation, '') AS nation FROM ({_RAW}))",
)
def _(spark, d):
    c = load(spark, d, "customer")
    raw = c.select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_custkey") % 7 == 0, "NA").otherwise(F.col("c_acctbal").cast("string")).alias("bal"),
        F.when(F.col("c_custkey") % 5 == 0, "true").otherwise("False").alias("flag"),
        F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
    )
    typed = tables.infer_types(raw)
    kinds = ",".join(t for _, t in typed.dtypes)
    return typed.agg(F.count("bal").alias("n_bal"), F.round(F.sum("bal"), 2).alias("sum_bal"), F.count_if("flag").alias("n_true"), F.sum("nation").alias("sum_nation"), F.lit(kinds).alias("kinds"))


# ---- profiles


def _target(name: str, table: str, column: str, n_cols: int) -> None:
    x = f"{column}::DOUBLE"

    @query(
        f"target_stats_{name}",
        f"SELECT count(*) AS n_rows, {n_cols}::BIGINT AS n_cols, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS min, max({x}) AS max, round(coalesce(skewness({x}), 0), 6) + 0.0 AS skew, count_if({column} IS NULL)::BIGINT AS missing FROM {table}",
    )
    def _(spark, d):
        return rounded(profile.target_stats(load(spark, d, table), column), 6, "mean", "std", "skew")


_target("lineitem", "lineitem", "l_extendedprice", 11)
_target("events", "events", "value", 6)
_target("part", "part", "p_retailprice", 6)
_target("documents", "documents", "n_chars", 5)

#: Tables that are profiled: target, order of rows, columns with the kind of their type.
PROFILED = {
    "orders": ("o_totalprice", "o_orderkey", {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_orderdate": "t", "o_orderpriority": "s"}),
    "part": ("p_retailprice", "p_partkey", {"p_partkey": "n", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "n"}),
    "events": ("value", "event_id", {"event_id": "n", "ts": "t", "user_id": "n", "event_type": "s", "props": "s"}),
    "customer": ("c_acctbal", "c_custkey", {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_mktsegment": "s"}),
    "supplier": ("s_acctbal", "s_suppkey", {"s_suppkey": "n", "s_name": "s", "s_nationkey": "n"}),
}


def _profile_sql(table: str) -> str:
    _, order, columns = PROFILED[table]
    parts = []
    for k, (c, t) in enumerate(columns.items()):
        if profile.has_id_name(c):
            kind = "'id_like'"
        elif t == "n":
            steps = f"(SELECT count_if(step < 0) = 0 OR count_if(step > 0) = 0 FROM (SELECT {c} - lag({c}) OVER (ORDER BY {order}) AS step FROM {table}))"
            kind = f"CASE WHEN count(DISTINCT {c}) = count(*) AND count_if({c} <> floor({c})) = 0 AND {steps} THEN 'id_like' ELSE 'numeric' END"
        elif t == "t":
            kind = "'datetime'"
        else:
            kind = f"CASE WHEN count(try_cast({c} AS TIMESTAMP)) > 0.85 * greatest(count({c}), 1) THEN 'datetime' ELSE 'categorical' END"
        parts.append(
            f'SELECT {k}::INTEGER AS position, \'{c}\' AS "column", {kind} AS kind, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "unique", '
            f"{'count(DISTINCT ' + c + ') > 20' if t == 's' else 'false'} AS high_cardinality FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _profiled(table: str) -> None:
    @query(f"profile_columns_{table}", _profile_sql(table))
    def _(spark, d):
        target, order, _ = PROFILED[table]
        df = load(spark, d, table)
        return profile.profile_table(df, profile.profile(df, target, [order])).drop("dtype", "low_variance")


for _name in PROFILED:
    _profiled(_name)


def _events_profile(spark, d):
    df = load(spark, d, "events")
    return df, profile.profile(df, "value", ["event_id"])


@query("kind_histogram", f"SELECT kind, count(*) AS n FROM ({_profile_sql('events')}) GROUP BY kind")
def _(spark, d):
    df, p = _events_profile(spark, d)
    return profile.profile_table(df, p).groupBy("kind").agg(F.count("*").alias("n"))


_GAPS = {
    "o_custkey": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END",
    "o_orderstatus": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END",
    "o_orderdate": "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END",
    "o_orderpriority": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END",
}


def _with_gaps(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", "o_totalprice", *(F.expr(e).alias(c) for c, e in _GAPS.items()))


@query(
    "missing_top5",
    'SELECT * FROM (' + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count_if(({e}) IS NULL) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM orders" for c, e in _GAPS.items()) + ') WHERE missing_pct > 5 ORDER BY missing_pct DESC LIMIT 5',
)
def _(spark, d):
    p = profile.profile(_with_gaps(spark, d), "o_totalprice", ["o_orderkey"])
    return spark.createDataFrame([(c, float(x)) for c, x in p.missing_most()], "column string, missing_pct double")


@query("missing_total", "SELECT (" + " + ".join(f"count_if(({e}) IS NULL)" for e in _GAPS.values()) + ")::BIGINT AS missing_total FROM orders")
def _(spark, d):
    p = profile.profile(_with_gaps(spark, d), "o_totalprice", ["o_orderkey"])
    return spark.createDataFrame([(p.missing_total,)], "missing_total long")


def _monotone(name: str, table: str, order: str, columns: list[str]) -> None:
    parts = [f"SELECT '{c}' AS \"column\", count_if(step < 0) = 0 OR count_if(step > 0) = 0 AS monotone FROM (SELECT {c} - lag({c}) OVER (ORDER BY {order}) AS step FROM {table})" for c in columns]

    @query(f"monotone_{name}", " UNION ALL ".join(parts))
    def _(spark, d):
        found = profile.monotone(load(spark, d, table), columns, [order])
        return spark.createDataFrame(list(found.items()), "column string, monotone boolean")


_monotone("orders", "orders", "o_orderkey", ["o_orderkey", "o_custkey"])
_monotone("part", "part", "p_partkey", ["p_partkey", "p_size"])
_monotone("events", "events", "event_id", ["event_id", "user_id"])

_TS = "CASE WHEN event_id % 10 = 0 THEN 'not a date' ELSE {} END"
_TS_SQL = _TS.format("strftime(ts, '%Y-%m-%d %H:%M:%S')")


@query("datetime_ratio_strings", f"SELECT round(count(try_cast(s AS TIMESTAMP)) / count(s)::DOUBLE, 6) AS share, count(try_cast(s AS TIMESTAMP)) > 0.85 * count(s) AS is_datetime FROM (SELECT {_TS_SQL} AS s FROM events)")
def _(spark, d):
    s = load(spark, d, "events").select(F.expr(_TS.format("date_format(ts, 'yyyy-MM-dd HH:mm:ss')")).alias("s"))
    fmt = profile.format_of([s.where("s <> 'not a date'").first()["s"]])
    share = profile.parse_shares(s, {"s": fmt})["s"]
    return spark.createDataFrame([(round(share, 6), share > 0.85)], "share double, is_datetime boolean")


def _dates(name: str, table: str, key: str, column: str, hour: bool) -> None:
    parts = f"extract(year FROM {column})::INTEGER AS {column}_year, extract(month FROM {column})::INTEGER AS {column}_month, extract(day FROM {column})::INTEGER AS {column}_day, (isodow({column}) - 1)::INTEGER AS {column}_weekday"

    @query(f"datetime_features_{name}", f"SELECT {key}, {parts}{f', hour({column})::INTEGER AS {column}_hour' if hour else ''} FROM {table}")
    def _(spark, d):
        df = load(spark, d, table).select(key, column)
        dates = {column: None}
        return features.date_parts(df, dates, features.columns_with_hours(df, dates))


_dates("orders", "orders", "o_orderkey", "o_orderdate", False)
_dates("events", "events", "event_id", "ts", True)


@query("low_variance", "SELECT unnest(['always', 'never']) AS \"column\"")
def _(spark, d):
    o = load(spark, d, "orders").withColumns({"always": F.lit("x"), "never": F.lit(None).cast("double")})
    return spark.createDataFrame([(c,) for c in features.constant_columns(o, {"o_totalprice"})], "column string")


@query("null_target_drop", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_custkey % 3 <> 0")
def _(spark, d):
    kept = features.drop_missing_target(_with_gaps(spark, d), "o_custkey")
    return kept.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _classified(name: str, table: str, numeric: list[str], others: list[str]) -> None:
    parts = [f"SELECT '{c}' AS \"column\", 'numeric' AS class" for c in numeric] + [f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) > 20 THEN 'high' ELSE 'low' END AS class FROM {table}" for c in others]

    @query(f"classify_columns_{name}", " UNION ALL ".join(parts))
    def _(spark, d):
        c = features.classify(load(spark, d, table), [*numeric, *others])
        rows = [(x, k) for k, xs in (("numeric", c.numeric), ("low", c.low_cardinality), ("high", c.high_cardinality)) for x in xs]
        return spark.createDataFrame(rows, "column string, class string")


_classified("part", "part", ["p_partkey", "p_size"], ["p_name", "p_brand", "p_type"])
_classified("documents", "documents", ["n_chars"], ["lang", "source"])

# ---- splits and folds


def _random_sql(table: str, key: str, columns: str = "*") -> str:
    return f"SELECT {columns}, CASE WHEN row_number() OVER (ORDER BY md5('42:' || {key}), {key}) <= ceil(round(count(*) OVER () * 0.2, 9)) THEN 'test' ELSE 'train' END AS split FROM {table}"


@query("split_random_members", _random_sql("orders", "o_orderkey", "o_orderkey"))
def _(spark, d):
    return splits.random_split(load(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "split")


_LINE_KEY = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"


@query("split_random_counts", f"SELECT split, count(*) AS n FROM ({_random_sql('lineitem', _LINE_KEY)}) GROUP BY split")
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return splits.random_split(load(spark, d, "lineitem"), keys).groupBy("split").agg(F.count("*").alias("n"))


@query("split_time_members", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts NULLS LAST, event_id) <= floor(count(*) OVER () * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split FROM events")
def _(spark, d):
    return splits.time_split(load(spark, d, "events"), "ts", ["event_id"]).select("event_id", "split")


@query("split_time_fallback", f"SELECT split, count(*) AS n, 'random, for want of the time column' AS how FROM ({_random_sql('events', 'event_id')}) GROUP BY split")
def _(spark, d):
    df, how = splits.split(load(spark, d, "events"), ["event_id"], "time", "no_such_column")
    return df.groupBy("split").agg(F.count("*").alias("n")).withColumn("how", F.lit(how))


@query("kfold_assign", "SELECT o_orderkey, (ntile(5) OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1)::INTEGER AS fold FROM orders")
def _(spark, d):
    return splits.kfold(load(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "fold")


_TSF = "SELECT k::INTEGER AS fold, (n - (5 - k) * (n // 6))::BIGINT AS n_train, (n // 6)::BIGINT AS n_test FROM (SELECT count(*) AS n FROM events), range(5) t(k)"


@query("time_series_folds", _TSF)
def _(spark, d):
    return splits.time_series_folds(load(spark, d, "events"), splits.time_order("ts", ["event_id"]))


@query("group_kfold_invariants", "SELECT 1::BIGINT AS folds_of_a_group, count(*) AS n_rows, count(DISTINCT user_id) AS n_groups, 5::BIGINT AS n_folds FROM events")
def _(spark, d):
    placed = splits.group_kfold(load(spark, d, "events"), "user_id")
    per = placed.groupBy("user_id").agg(F.count_distinct("fold").alias("k")).agg(F.max("k").alias("folds_of_a_group"))
    whole = placed.agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_groups"), F.count_distinct("fold").alias("n_folds"))
    row = per.first()
    return whole.select(F.lit(row["folds_of_a_group"]).cast("long").alias("folds_of_a_group"), "n_rows", "n_groups", "n_folds")


# ---- features

_SIZE = "CASE WHEN p_size > 45 THEN NULL ELSE p_size END"


def _part_gaps(spark, d):
    return load(spark, d, "part").withColumn("p_size", F.expr(_SIZE)).withColumn("p_type", F.expr("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END"))


@query("impute_median", f"WITH p AS (SELECT p_partkey, {_SIZE} AS s FROM part) SELECT p_partkey, coalesce(s, (SELECT quantile_cont(s, 0.5) FROM p))::DOUBLE AS p_size FROM p")
def _(spark, d):
    p = _part_gaps(spark, d)
    m = features.exact_medians(p, ["p_size"])["p_size"]
    return p.select("p_partkey", F.coalesce(F.col("p_size").cast("double"), F.lit(m)).alias("p_size"))


@query("impute_mode", "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS t FROM part) SELECT p_partkey, coalesce(t, (SELECT t FROM p WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)) AS p_type FROM p")
def _(spark, d):
    p = _part_gaps(spark, d)
    return p.select("p_partkey", F.coalesce("p_type", F.lit(features.modes(p, ["p_type"])["p_type"])).alias("p_type"))


_PART_SPLIT = _random_sql("part", "p_partkey")


def _part_split(spark, d, df=None):
    return splits.random_split(load(spark, d, "part") if df is None else df, ["p_partkey"])


@query("freq_encode", f"WITH s AS ({_PART_SPLIT}), f AS (SELECT p_brand, count(*) / (SELECT count(*) FROM s WHERE split = 'train')::DOUBLE AS share FROM s WHERE split = 'train' GROUP BY p_brand) SELECT p_partkey, round(coalesce(share, 0), 9) AS p_brand FROM s LEFT JOIN f USING (p_brand) WHERE split = 'test'")
def _(spark, d):
    s = _part_split(spark, d)
    shares = features.frequencies(s.where("split = 'train'"), "p_brand")
    return rounded(features.frequency_encode(s.where("split = 'test'"), "p_brand", shares).select("p_partkey", "p_brand"), 9, "p_brand")


_MATRIX = f"""
WITH g AS (SELECT p_partkey, p_retailprice, p_brand, {_SIZE} AS p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS p_type FROM part),
s AS ({_random_sql("g", "p_partkey")}), t AS (SELECT * FROM s WHERE split = 'train'),
med AS (SELECT quantile_cont(p_size, 0.5) AS m FROM t), top AS (SELECT p_type AS v FROM t WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1),
f AS (SELECT p_brand, count(*) / (SELECT count(*) FROM t)::DOUBLE AS share FROM t GROUP BY p_brand),
x AS (SELECT s.*, coalesce(p_size, m)::DOUBLE AS size, coalesce(share, 0) AS brand, coalesce(p_type, v) AS type FROM s LEFT JOIN f USING (p_brand), med, top),
st AS (SELECT avg(size) AS ms, stddev_pop(size) AS ss, avg(brand) AS mb, stddev_pop(brand) AS sb FROM x WHERE split = 'train')
SELECT p_partkey, split, round((size - ms) / ss, 6) AS f0, round((brand - mb) / sb, 6) AS f1"""


def _matrix(spark, d):
    g = _part_gaps(spark, d)
    s = _part_split(spark, d, g.select("p_partkey", "p_retailprice", "p_brand", "p_size", "p_type"))
    return s, features.fit_features(s.where("split = 'train'"), "p_retailprice", ["p_size", "p_brand", "p_type"])


@query("scale_standard", _MATRIX + " FROM x, st")
def _(spark, d):
    s, m = _matrix(spark, d)
    return rounded(m.flat(s, ["p_partkey", "split"]).select("p_partkey", "split", "f0", "f1"), 6, "f0", "f1")


@query("one_hot", _MATRIX.split("SELECT p_partkey, split, round")[0] + " SELECT p_partkey, value, 1.0::DOUBLE AS hot FROM (SELECT p_partkey, 'p_type_' || type AS value FROM x)")
def _(spark, d):
    s, m = _matrix(spark, d)
    flat = m.flat(s, ["p_partkey"])
    start = len(m.numeric) + len(m.frequency)
    hot = F.array_compact(F.array(*(F.when(F.col(f"f{k}") > 0, F.struct(F.lit(m.names[k]).alias("value"), F.col(f"f{k}").alias("hot"))) for k in range(start, len(m.names)))))
    return flat.select("p_partkey", F.explode(hot).alias("h")).select("p_partkey", "h.value", "h.hot")


@query("feature_matrix_wide", _MATRIX + ", round((SELECT count(*) FROM (SELECT DISTINCT type FROM x WHERE split = 'train')), 0)::BIGINT AS n_hot FROM x, st WHERE split = 'test'")
def _(spark, d):
    s, m = _matrix(spark, d)
    flat = m.flat(s.where("split = 'test'"), ["p_partkey", "split"])
    return rounded(flat.select("p_partkey", "split", "f0", "f1", F.lit(len(m.names) - 2).cast("long").alias("n_hot")), 6, "f0", "f1")


@query("log1p_roundtrip", "SELECT event_id, round(ln(1 + value), 9) AS logged, round(exp(ln(1 + value)) - 1, 6) AS back FROM events")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", F.log1p("value").alias("label")).withColumn("prediction", F.col("label"))
    back = training.original_units(e, "log1p")
    return rounded(e.select("event_id", F.col("label").alias("logged")).join(back.select("event_id", F.col("label").alias("back")), "event_id"), 9, "logged").withColumn("back", F.round("back", 6))


@query("log_guard", "SELECT 'c_acctbal' AS target, min(c_acctbal) >= 0 AS can_log FROM customer UNION ALL SELECT 'value', min(value) >= 0 FROM events")
def _(spark, d):
    rows = [("c_acctbal", features.can_log("c_acctbal", load(spark, d, "customer"))), ("value", features.can_log("value", load(spark, d, "events")))]
    return spark.createDataFrame(rows, "target string, can_log boolean")


# ---- models with one feature, in closed form

_XY = f"SELECT p_partkey, p_partkey / 1000.0::DOUBLE AS x, p_retailprice AS y, split FROM ({_PART_SPLIT})"
_SUMS = f"WITH s AS ({_XY}), m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS sxy, var_pop(x) AS sxx, count(*) AS n FROM s WHERE split = 'train')"


def _one_feature(spark, d):
    s = _part_split(spark, d)
    rows = s.select("p_partkey", "split", (F.col("p_partkey") / 1000.0).alias("x"), F.col("p_retailprice").alias("label"))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)


def _closed(name: str, model, slope: str) -> None:
    @query(name, f"{_SUMS} SELECT round({slope}, 4) AS slope, round(my - ({slope}) * mx, 3) AS intercept FROM m")
    def _(spark, d):
        fitted = model.fit(_one_feature(spark, d).where("split = 'train'")).model
        return spark.createDataFrame([(round(float(fitted.coefficients[0]), 4), round(float(fitted.intercept), 3))], "slope double, intercept double")


_closed("ols_1f", models.Linear(), "sxy / sxx")
_closed("ridge_1f", models.Linear(alpha=50.0, ridge=True), "sxy / (sxx + 50.0 / n)")
_closed("lasso_1f", models.Linear(alpha=2.0, l1_ratio=1.0), "sign(sxy) * greatest(abs(sxy) - 2.0, 0) / sxx")
_closed("elastic_net_1f", models.Linear(alpha=2.0, l1_ratio=0.5), "sign(sxy) * greatest(abs(sxy) - 1.0, 0) / (sxx + 1.0)")


@query(
    "knn_k5",
    f"WITH s AS ({_PART_SPLIT}), c AS (SELECT t.p_partkey, a.p_retailprice AS y, row_number() OVER (PARTITION BY t.p_partkey ORDER BY (t.p_partkey - a.p_partkey) ** 2 + (t.p_size - a.p_size) ** 2, a.p_retailprice) AS k FROM s t, s a WHERE t.split = 'test' AND a.split = 'train') SELECT p_partkey, round(avg(y), 6) AS prediction FROM c WHERE k <= 5 GROUP BY p_partkey",
)
def _(spark, d):
    s = _part_split(spark, d).withColumn("label", F.col("p_retailprice"))
    s = VectorAssembler(inputCols=["p_partkey", "p_size"], outputCol="features").transform(s)
    fitted = models.Neighbours(5).fit(s.where("split = 'train'").select("features", "label"))
    return rounded(fitted.transform(s.where("split = 'test'").select("p_partkey", "features")).select("p_partkey", "prediction"), 6, "prediction")


@query(
    "knn_pruning",
    f"WITH s AS ({_PART_SPLIT}), n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT p_partkey, p_size FROM s WHERE split = 'test')) AS queries, (SELECT count(*) FROM (SELECT DISTINCT p_partkey, p_size, p_retailprice FROM s WHERE split = 'train')) AS train_rows) SELECT queries, train_rows, queries * train_rows AS pairs, true AS fewer_compared FROM n",
)
def _(spark, d):
    """How many pairs the exact nearest-neighbour search has, and whether it compared fewer."""
    s = _part_split(spark, d).withColumn("label", F.col("p_retailprice"))
    s = VectorAssembler(inputCols=["p_partkey", "p_size"], outputCol="features").transform(s)
    fitted = models.Neighbours(5).fit(s.where("split = 'train'").select("features", "label"))
    work = fitted.work(s.where("split = 'test'").select("features"))
    return work.select("queries", "train_rows", "pairs", (F.col("compared") < F.col("pairs")).alias("fewer_compared"))


@query(
    "stump",
    f"""WITH t AS (SELECT p_size AS x, p_retailprice AS y FROM ({_PART_SPLIT}) WHERE split = 'train'),
g AS (SELECT x, count(*) AS n, sum(y) AS sy FROM t GROUP BY x), c AS (SELECT x, sum(n) OVER w AS nl, sum(sy) OVER w AS sl, sum(n) OVER () AS n, sum(sy) OVER () AS s FROM g WINDOW w AS (ORDER BY x)),
best AS (SELECT x, sl / nl AS l, (s - sl) / (n - nl) AS r FROM c WHERE nl < n ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)
SELECT DISTINCT p.p_size, round(CASE WHEN p.p_size <= best.x THEN l ELSE r END, 6) AS prediction FROM part p, best""",
)
def _(spark, d):
    s = _part_split(spark, d).withColumn("label", F.col("p_retailprice"))
    s = VectorAssembler(inputCols=["p_size"], outputCol="features").transform(s)
    fitted = models.Tree(max_depth=1).fit(s.where("split = 'train'").select("features", "label"))
    return rounded(fitted.transform(s).select("p_size", "prediction").distinct(), 6, "prediction")


# ---- metrics, ranking, audit: three predictors of a part's price

_PRED = f"""{_SUMS},
pred AS (SELECT 'ols' AS model, split, p_partkey, y AS label, my + sxy / sxx * (x - mx) AS prediction FROM s, m UNION ALL SELECT 'mean', split, p_partkey, y, my FROM s, m UNION ALL SELECT 'tilted', split, p_partkey, y, my + x * 0.7071 FROM s, m),
met AS (SELECT model, split, avg(abs(label - prediction)) AS mae, sqrt(avg((label - prediction) ** 2)) AS rmse, avg((label - prediction) ** 2) AS mse, 1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)) AS r2, median(abs(label - prediction)) AS median_ae, avg(abs((label - prediction) / label)) * 100 AS mape_pct FROM pred GROUP BY model, split),
wide AS (SELECT a.model, a.mae, a.rmse, a.mse, a.r2, a.median_ae, a.mape_pct, b.r2 AS r2_train, b.rmse AS rmse_train FROM met a JOIN met b ON a.model = b.model AND a.split = 'test' AND b.split = 'train')"""


def _predictions(spark, d):
    """model, split, p_partkey, label, prediction of least squares, the mean and a tilted mean."""
    rows = _one_feature(spark, d)
    train = rows.where("split = 'train'")
    mean = train.agg(F.avg("label")).first()[0]
    parts = [models.Linear().fit(train).transform(rows).withColumn("model", F.lit("ols")), rows.withColumns({"prediction": F.lit(mean), "model": F.lit("mean")}), rows.withColumns({"prediction": F.lit(mean) + F.col("x") * 0.7071, "model": F.lit("tilted")})]
    return reduce(DataFrame.unionByName, [p.select("model", "split", "p_partkey", "label", "prediction") for p in parts])


def _metrics(spark, d):
    m = training.evaluate(_predictions(spark, d), by=["model", "split"])
    train = m.where("split = 'train'").select("model", F.col("r2").alias("r2_train"), F.col("rmse").alias("rmse_train"))
    return m.where("split = 'test'").drop("split").join(train, "model")


_DIGITS = ("mae", "rmse", "mse", "r2", "median_ae", "mape_pct")


@query("metrics_by_split", f"{_PRED} SELECT model, split, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in _DIGITS) + " FROM met")
def _(spark, d):
    return rounded(training.evaluate(_predictions(spark, d), by=["model", "split"]), 4, *_DIGITS)


@query("metrics_zero_targets", "SELECT round(avg(abs(label - 1)), 6) AS mae, round(avg(CASE WHEN label <> 0 THEN abs((label - 1) / label) END) * 100, 4) AS mape_pct FROM (SELECT (p_size % 5)::DOUBLE AS label FROM part)")
def _(spark, d):
    rows = load(spark, d, "part").select((F.col("p_size") % 5).cast("double").alias("label"), F.lit(1.0).alias("prediction"))
    return rounded(training.evaluate(rows).select("mae", "mape_pct"), 6, "mae").withColumn("mape_pct", F.round("mape_pct", 4))


@query("rank_models", f"{_PRED} SELECT model, row_number() OVER (ORDER BY rmse, r2 DESC, model)::INTEGER AS rank FROM wide")
def _(spark, d):
    return training.ranked(_metrics(spark, d)).select("model", "rank")


@query("metrics_table", f"{_PRED} SELECT model, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) + 0.0 AS r2, round(median_ae, 4) AS median_ae, round(mape_pct, 2) AS mape_pct, round(r2_train, 4) + 0.0 AS r2_train, round(rmse_train, 4) AS rmse_train FROM wide")
def _(spark, d):
    return rounded(training.metrics_table(_metrics(spark, d)), 4, "r2", "r2_train")


@query("winners", f"{_PRED}, t AS (SELECT model, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2 FROM wide) SELECT 'rmse' AS metric, (SELECT model FROM t ORDER BY rmse, model LIMIT 1) AS model UNION ALL SELECT 'mae', (SELECT model FROM t ORDER BY mae, rmse, model LIMIT 1) UNION ALL SELECT 'r2', (SELECT model FROM t ORDER BY r2 DESC, rmse, model LIMIT 1)")
def _(spark, d):
    return training.winners(_metrics(spark, d))


_CV = f"""{_SUMS.replace(", m AS", ", q AS (SELECT *, ntile(5) OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1 AS fold FROM s WHERE split = 'train'), m AS")},
f AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT DISTINCT fold FROM q) k JOIN q ON q.fold <> k.fold GROUP BY k.fold),
cv AS (SELECT q.fold::INTEGER AS fold, 1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - a - b * x) ** 2)) AS rmse FROM q JOIN f USING (fold) GROUP BY q.fold)"""


def _cv(spark, d):
    train = splits.kfold(_one_feature(spark, d).where("split = 'train'"), ["p_partkey"])
    scores = training.cross_validate(models.Linear(), train, training.Folds.by_column("fold", 5))
    return scores, spark.createDataFrame([("ols", k, s["r2"], s["rmse"]) for k, s in enumerate(scores)], "model string, fold int, r2 double, rmse double")


@query("cv_scores_ols", f"{_CV} SELECT fold, round(r2, 5) AS r2, round(rmse, 5) AS rmse FROM cv")
def _(spark, d):
    return rounded(_cv(spark, d)[1].drop("model"), 5, "r2", "rmse")


@query("cv_summary", f"{_CV} SELECT round(avg(r2), 5) AS cv_r2_mean, round(stddev_pop(r2), 5) AS cv_r2_std, round(avg(rmse), 5) AS cv_rmse_mean FROM cv")
def _(spark, d):
    s = training.cv_summary(_cv(spark, d)[0])
    return spark.createDataFrame([tuple(round(s[k], 5) for k in ("cv_r2_mean", "cv_r2_std", "cv_rmse_mean"))], "cv_r2_mean double, cv_r2_std double, cv_rmse_mean double")


_POINTS = [(n, p["alpha"], {"Ridge": 0.0, "Lasso": 1.0}.get(n, p.get("l1_ratio"))) for n in ("Ridge", "Lasso", "ElasticNet") for p in training.grid_of(n)]
_GRID = _CV.split("\nf AS")[0] + f"""
t AS (SELECT k.fold, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(y, x) AS cxy FROM (SELECT DISTINCT fold FROM q) k JOIN q ON q.fold <> k.fold GROUP BY k.fold),
p(model, alpha, l1_ratio) AS (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {r}::DOUBLE)" for n, a, r in _POINTS)}),
w AS (SELECT model, alpha, l1_ratio, fold, mx, my, CASE WHEN model = 'Ridge' THEN n * cxy / (n * vx + alpha) ELSE sign(cxy) * greatest(abs(cxy) - alpha * l1_ratio, 0) / (vx + alpha * (1 - l1_ratio)) END AS b FROM t, p),
e AS (SELECT w.model, w.alpha, w.l1_ratio, q.fold, q.y, q.y - w.my - w.b * (q.x - w.mx) AS e FROM w JOIN q USING (fold))"""


def _grid(spark, d):
    """A row for each point of the linear family's grids and fold, from one scan of the training rows."""
    train = splits.kfold(_one_feature(spark, d).where("split = 'train'"), ["p_partkey"])
    points = [models.Linear(alpha=a, l1_ratio=r, ridge=n == "Ridge") for n, a, r in _POINTS]
    scores = training.linear_grid(train, training.Folds.by_column("fold", 5), points)
    return spark.createDataFrame([(*p, k, s["r2"], s["rmse"]) for p, point in zip(_POINTS, scores) for k, s in enumerate(point)], "model string, alpha double, l1_ratio double, fold int, r2 double, rmse double")


@query("linear_grid_1f", f"{_GRID} SELECT model, alpha, l1_ratio, fold::INTEGER AS fold, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) + 0.0 AS r2, round(sqrt(avg(e * e)), 5) AS rmse FROM e GROUP BY model, alpha, l1_ratio, fold")
def _(spark, d):
    return rounded(rounded(_grid(spark, d), 6, "r2"), 5, "rmse")


@query("linear_grid_best_1f", f"{_GRID}, g AS (SELECT model, alpha, l1_ratio, fold, sqrt(avg(e * e)) AS rmse FROM e GROUP BY ALL), m2 AS (SELECT model, alpha, l1_ratio, avg(rmse) AS mean FROM g GROUP BY ALL) SELECT model, round(min(mean), 5) AS cv_rmse_mean FROM m2 GROUP BY model")
def _(spark, d):
    means = _grid(spark, d).groupBy("model", "alpha", "l1_ratio").agg(F.avg("rmse").alias("mean"))
    return rounded(means.groupBy("model").agg(F.min("mean").alias("cv_rmse_mean")), 5, "cv_rmse_mean")


def _documents(spark, d):
    return load(spark, d, "documents").select("n_chars", F.length("text").alias("length"), F.col("doc_id").alias("place"), F.lit(3).alias("three"))


@query("leakage_corr", "SELECT 'length' AS \"column\", round(abs(corr(n_chars, length(text))), 6) AS correlation FROM documents")
def _(spark, d):
    return rounded(audit.leaks(_documents(spark, d), "n_chars"), 6, "correlation")


@query("target_correlations", "SELECT 'length' AS \"column\", round(corr(n_chars, length(text)), 6) AS correlation FROM documents UNION ALL SELECT 'place', round(corr(n_chars, doc_id), 6) FROM documents UNION ALL SELECT 'three', NULL")
def _(spark, d):
    return rounded(audit.target_correlations(_documents(spark, d), "n_chars"), 6, "correlation")


_AUDIT = f"""{_PRED},
x AS (SELECT skewness(n_chars) AS skew, abs(corr(n_chars, length(text))) AS r FROM documents), v AS (SELECT model, r2, r2_train FROM wide)
SELECT 1::INTEGER AS rule_order, 'leakage' AS rule, 'length' AS subject, round(r, 4) AS value FROM x WHERE r > 0.99
UNION ALL SELECT 3, 'skewed_target', 'n_chars', round(skew, 4) FROM x WHERE abs(skew) > 2
UNION ALL SELECT 4, 'wide_data', 'n_chars', 500 FROM x
UNION ALL SELECT 5, 'perfect_fit_with_leak', model, round(r2, 4) FROM v WHERE r2 > 0.9999 AND r2_train > 0.9999
UNION ALL SELECT 6, 'overfit', model, round(r2_train - r2, 4) FROM v WHERE NOT (r2 > 0.9999 AND r2_train > 0.9999) AND r2_train - r2 > 0.2
UNION ALL SELECT 7, 'worse_than_mean', model, round(r2, 4) + 0.0 FROM v WHERE r2 < -1e-9"""


@query("audit_findings", _AUDIT)
def _(spark, d):
    docs, scores = _documents(spark, d), _metrics(spark, d).where("model <> 'mean' or r2 < -1e-9")
    s = profile.target_stats(docs, "n_chars").first()
    return rounded(audit.findings(docs, "n_chars", scores, std=s["std"], skew=s["skew"], n_features=500, n_train=400, log_requested=False), 4, "value")


@query("audit_degenerate_target", "SELECT 2::INTEGER AS rule_order, 'degenerate_target' AS rule, 'flat' AS subject, stddev_samp(flat) AS value FROM (SELECT (p_size - p_size + 3)::DOUBLE AS flat FROM part) HAVING stddev_samp(flat) < 1e-9")
def _(spark, d):
    flat = load(spark, d, "part").select((F.col("p_size") - F.col("p_size") + 3).cast("double").alias("flat"), "p_size")
    s = profile.target_stats(flat, "flat").first()
    scores = _metrics(spark, d).limit(0)
    return audit.findings(flat, "flat", scores, std=s["std"], skew=s["skew"], n_features=1, n_train=400, log_requested=False)


@query("overfit_flags", f"{_PRED} SELECT model, round(r2_train - r2, 6) + 0.0 AS gap, r2_train - r2 > 0.15 AS overfit, r2 > 0.9999 AND r2_train > 0.9999 AS perfect FROM wide")
def _(spark, d):
    return rounded(audit.overfit_flags(_metrics(spark, d)), 6, "gap")


# ---- chart data


def _test_predictions(spark, d):
    return _predictions(spark, d).where("split = 'test'")


@query("chart_overlay", f"{_PRED} SELECT model, label AS actual, round(prediction, 4) AS predicted FROM pred WHERE split = 'test'")
def _(spark, d):
    return rounded(charts.overlay(_test_predictions(spark, d)), 4, "predicted")


@query("chart_predicted_vs_actual", f"{_PRED} SELECT label AS actual, round(prediction, 4) AS predicted FROM pred WHERE split = 'test' AND model = 'ols'")
def _(spark, d):
    return rounded(charts.predicted_vs_actual(_test_predictions(spark, d).where("model = 'ols'")), 4, "predicted")


@query("chart_diagonal", f"{_PRED} SELECT round(least(min(label), min(prediction)), 4) AS low, round(greatest(max(label), max(prediction)), 4) AS high FROM pred WHERE split = 'test'")
def _(spark, d):
    return rounded(charts.diagonal(_test_predictions(spark, d)), 4, "low", "high")


@query("chart_residuals", f"{_PRED} SELECT round(prediction, 4) AS predicted, round(label - prediction, 4) AS residual FROM pred WHERE split = 'test' AND model = 'ols'")
def _(spark, d):
    return rounded(charts.residuals(_test_predictions(spark, d).where("model = 'ols'")), 4, "predicted", "residual")


def _histogram_sql(source: str, x: str) -> str:
    return f"h AS (SELECT {x} AS v FROM {source}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM h) SELECT least(floor((v - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, round(lo + least(floor((v - lo) / ((hi - lo) / 40)), 39) * ((hi - lo) / 40), 3) AS low, count(*) AS n FROM h, e GROUP BY ALL"


@query("chart_residual_histogram", f"{_PRED}, {_histogram_sql('pred', 'label - prediction')}".replace("FROM pred), e", "FROM pred WHERE model = 'tilted' AND split = 'test'), e"))
def _(spark, d):
    return rounded(charts.residual_histogram(_test_predictions(spark, d).where("model = 'tilted'")).drop("high"), 3, "low")


@query("chart_target_histogram", f"WITH {_histogram_sql('events', 'value')}")
def _(spark, d):
    return rounded(charts.target_histogram(load(spark, d, "events"), "value").drop("high"), 3, "low")


_QQ = f"{_PRED}, o AS (SELECT label - prediction AS sample, row_number() OVER (ORDER BY label - prediction)::DOUBLE AS i, count(*) OVER ()::DOUBLE AS n FROM pred WHERE model = 'ols' AND split = 'test'), u AS (SELECT sample, {order_median_sql('i', 'n')} AS m FROM o), z AS (SELECT {normal_quantile_sql('m')} AS theoretical, sample FROM u)"


def _qq(spark, d):
    return charts.qq_points(_test_predictions(spark, d).where("model = 'ols'"))


@query("chart_qq_points", f"{_QQ} SELECT round(theoretical, 5) AS theoretical, round(sample, 4) AS sample FROM z")
def _(spark, d):
    return rounded(_qq(spark, d), 4, "sample").withColumn("theoretical", F.round("theoretical", 5))


@query("chart_qq_line", f"{_QQ} SELECT round(regr_slope(sample, theoretical), 4) AS slope, round(regr_intercept(sample, theoretical), 4) AS intercept FROM z")
def _(spark, d):
    return rounded(charts.qq_line(_qq(spark, d)), 4, "slope", "intercept")


_SLOPES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("chart_importance_top", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(regr_slope(l_extendedprice, {c})), 3) AS importance FROM lineitem" for c in _SLOPES) + ") ORDER BY importance DESC LIMIT 3")
def _(spark, d):
    """The three features whose slopes, fitted one by one, are steepest."""
    rows = load(spark, d, "lineitem").select(*_SLOPES, F.col("l_extendedprice").alias("label"))
    whole = grams.moments(VectorAssembler(inputCols=[*_SLOPES], outputCol="features").transform(rows), F.lit(0)).get(0)  # none without labelled rows
    fitted = {c: models.Linear().fit(VectorAssembler(inputCols=[c], outputCol="features").transform(rows), whole and whole.only(k)) for k, c in enumerate(_SLOPES)}
    made = spark.createDataFrame([("slopes", c, float(f.importances[0])) for c, f in fitted.items()], "model string, feature string, importance double")
    return rounded(charts.top_importances(made, "slopes", 3), 3, "importance")


@query("chart_cv_box", f"{_CV} SELECT 'ols' AS model, round(min(r2), 5) AS low, round(quantile_cont(r2, 0.25), 5) AS q1, round(median(r2), 5) AS median, round(quantile_cont(r2, 0.75), 5) AS q3, round(max(r2), 5) AS high, round(avg(r2), 5) AS mean FROM cv")
def _(spark, d):
    return rounded(charts.cv_box(_cv(spark, d)[1]), 5, "low", "q1", "median", "q3", "high", "mean")


@query("chart_cv_points", f"{_CV} SELECT 'ols' AS model, round(r2, 5) AS r2 FROM cv")
def _(spark, d):
    return rounded(charts.cv_points(_cv(spark, d)[1]), 5, "r2")


@query("chart_metric_bars", f"{_PRED} SELECT model, round(rmse, 4) AS value FROM wide")
def _(spark, d):
    return rounded(charts.metric_bars(_metrics(spark, d), "rmse"), 4, "value")


@query("chart_error_bars", f"{_PRED} SELECT model, 'mae' AS metric, round(mae, 4) AS value FROM wide UNION ALL SELECT model, 'rmse', round(rmse, 4) FROM wide UNION ALL SELECT model, 'median_ae', round(median_ae, 4) FROM wide")
def _(spark, d):
    return rounded(charts.error_bars(_metrics(spark, d)), 4, "value")


# ---- what SQL can't express: fitted models and whole analyses (their tests hold them to other standards)


def _prepared(spark, d):
    data = tables.Dataset(load(spark, d, "part"))
    return prepare(data, Options("p_retailprice", auto_drop_id_columns=False, cv_folds=3))


def _fitted(name: str, model) -> None:
    @query(f"model_{name}")
    def _(spark, d):
        p = _prepared(spark, d)
        r = training.train_and_evaluate(p.train, p.test, {name: model}, training.Folds([]))
        return training.results_table(spark, r).select("model", *training.METRICS, "r2_train", "rmse_train")


_fitted("linear", models.Linear())
_fitted("ridge", models.Linear(alpha=1.0, ridge=True))
_fitted("lasso", models.Linear(alpha=0.01, l1_ratio=1.0))
_fitted("elastic_net", models.Linear(alpha=0.01, l1_ratio=0.5))
_fitted("tree", models.Tree())
_fitted("forest", models.Forest())
_fitted("forest_8", models.Forest(n_estimators=20, max_depth=8))
_fitted("boosting", models.Boosting(n_estimators=20))
_fitted("knn", models.Neighbours())
_fitted("svr", models.KernelSVR())


@query("tuned_ridge")
def _(spark, d):
    p = _prepared(spark, d)
    _, params = training.tune("Ridge", models.Linear(alpha=1.0, ridge=True), p.train.persist(), p.folds)
    return spark.createDataFrame([(params["alpha"],)], "alpha double")


@query("analysis_metrics")
def _(spark, d):
    from lathe.plans.analysis import analyze

    chosen = {"LinearRegression": models.Linear(), "DecisionTree": models.Tree(5)}
    r = analyze(load(spark, d, "orders"), Options("o_totalprice", cv_folds=3, models=chosen))
    return r.metrics.select("model", "rank", *training.METRICS, "r2_train", "cv_r2_mean")


@query("flagship")
def _(spark, d):
    """Which columns does l_extendedprice depend on? Profile, split, least squares and its metrics."""
    from lathe.plans.analysis import analyze

    r = analyze(load(spark, d, "lineitem"), Options("l_extendedprice", cv_folds=2, models={"LinearRegression": models.Linear()}))
    return r.metrics.select("model", "rank", *training.METRICS, "r2_train", "rmse_train", "cv_r2_mean")
