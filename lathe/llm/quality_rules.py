"""Quality rules with host-level verdicts (operator 6). DataFrame functions only.

Every document is measured by functions on arrays of its words and lines. Rule failures are summed by
host; a host's failure rate is shrunk towards the rate of all hosts by a beta prior whose parameters
follow from the mean and variance of the hosts' rates (method of moments), so a host with few documents
isn't condemned by them. Hosts whose shrunk rate of some rule exceeds its limit are rejected, and the
verdict is joined back to their documents. Failures are summed before the shuffle, so a host with a
third of all documents is a few partial sums; the joined rows carry no text.

Words in windows that repeat are found by the 64-bit hashes of the windows of the same text.

Edge cases: null text is the empty text and fails the rule on length; a null host is a host of its own;
with one host, or hosts that fail alike, the prior is that of PRIOR_STRENGTH documents at the common
rate; repeated rows count each time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import common

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 50
#: Hosts whose shrunk failure rate exceeds a rule's limit are rejected.
HOST_LIMITS = {"base": 0.6, "symbols": 0.6, "lines": 0.6}
PRIOR_STRENGTH = 10.0
_BLANKS = " \t\n\x0b\f\r"


def measures(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep's columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(_BLANKS))
    none = F.array().cast("array<string>")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != "")
    rows = docs.select(*keep, text.alias("_text"), F.when(trimmed == "", none).otherwise(F.split(trimmed, common.SPACE + "+")).alias("_words"))
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    rows = rows.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_hashes"), i, F.lit(WINDOW))))).alias("_windows"),
    )
    has = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(has, ordered)).drop("_windows")
    rows = rows.withColumn("_repeats", F.when(F.col("_sorted").isNotNull(), _repeated(F.col("_sorted")))).drop("_sorted")
    return rows.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_repeats")), F.lit(0)).cast("long")).drop("_repeats")


def _repeated(ordered: Column) -> Column:
    """Sorted positions of the windows whose hash another one has; ordered: (hash, position), sorted."""
    blank = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(blank, F.slice(ordered, 1, F.size(ordered) - 1))
    after = F.concat(F.slice(ordered, 2, F.size(ordered) - 1), blank)
    near = F.zip_with(F.zip_with(ordered, before, lambda x, b: F.struct(x["i"].alias("i"), x["h"].alias("h"), x["h"].eqNullSafe(b["h"]).alias("same"))), after, lambda x, a: F.struct(x["i"].alias("i"), (x["same"] | x["h"].eqNullSafe(a["h"])).alias("same")))
    return F.array_sort(F.transform(F.filter(near, lambda x: x["same"]), lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """How many words the windows that begin at `starts` cover together."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(starts, none, lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda acc: acc["n"])


def rules() -> dict[str, Column]:
    """The conditions under which a measured document fails."""
    return {
        "base": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, host_col: str, limits: dict[str, float] | None = None) -> DataFrame:
    """_host, rate_<rule> (shrunk) and host_ok for each host of a measured table."""
    limits = limits or HOST_LIMITS
    failed = {k: F.coalesce(c, F.lit(False)).cast("double") for k, c in rules().items()}
    hosts = measured.groupBy(F.col(host_col).alias("_host")).agg(F.count("*").cast("double").alias("_n"), *(F.sum(c).alias(f"_f_{k}") for k, c in failed.items()))
    spread = hosts.agg(*(f(F.col(f"_f_{k}") / F.col("_n")).alias(f"{name}_{k}") for k in failed for name, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    rates = []
    for k in failed:
        mean, var = spread[f"mean_{k}"] or 0.0, spread[f"var_{k}"] or 0.0
        strength = mean * (1 - mean) / var - 1 if var > 1e-12 and 0 < mean < 1 else PRIOR_STRENGTH
        strength = max(strength, 1.0)
        rates.append(((F.col(f"_f_{k}") + mean * strength) / (F.col("_n") + strength)).alias(f"rate_{k}"))
    verdicts = hosts.select("_host", *rates)
    ok = F.lit(True)
    for k in failed:
        ok = ok & (F.col(f"rate_{k}") <= limits[k])
    return verdicts.withColumn("host_ok", ok)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host and measures of each document, base_failed, its host's rates, host_ok and kept."""
    measured = measures(docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("_raw")), "_raw", ["id", "host"])
    measured = common.durable(measured.withColumn("base_failed", rules()["base"]), "measured")
    verdicts = host_verdicts(measured, "host")
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["_host"]), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    out = apply_rules(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, source, coalesce(text, '') AS t, {_WORDS_SQL} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) > {WINDOW - 1})),
rep AS (SELECT doc, i, lead(i) OVER (PARTITION BY doc ORDER BY i) AS j FROM (SELECT doc, i, count(*) OVER (PARTITION BY doc, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc, sum(least({WINDOW}, coalesce(j - i, {WINDOW}))) AS n FROM rep GROUP BY doc),
m AS (SELECT d.doc, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN cov ON cov.doc = d.doc),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, 100 * n_symbols > {SYMBOL_PERCENT} * word_chars AS sym, 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines AS dup FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS fb, sum(sym::INT)::DOUBLE AS fs, sum(dup::INT)::DOUBLE AS fl FROM f GROUP BY source),
p AS (SELECT avg(fb / n) AS mb, var_pop(fb / n) AS vb, avg(fs / n) AS ms, var_pop(fs / n) AS vs, avg(fl / n) AS ml, var_pop(fl / n) AS vl FROM h),
q AS (SELECT mb, ms, ml,
    greatest(CASE WHEN vb > 1e-12 AND mb > 0 AND mb < 1 THEN mb * (1 - mb) / vb - 1 ELSE {PRIOR_STRENGTH} END, 1.0) AS sb,
    greatest(CASE WHEN vs > 1e-12 AND ms > 0 AND ms < 1 THEN ms * (1 - ms) / vs - 1 ELSE {PRIOR_STRENGTH} END, 1.0) AS ss,
    greatest(CASE WHEN vl > 1e-12 AND ml > 0 AND ml < 1 THEN ml * (1 - ml) / vl - 1 ELSE {PRIOR_STRENGTH} END, 1.0) AS sl FROM p),
v AS (SELECT source, (fb + mb * sb) / (n + sb) <= {HOST_LIMITS["base"]} AND (fs + ms * ss) / (n + ss) <= {HOST_LIMITS["symbols"]} AND (fl + ml * sl) / (n + sl) <= {HOST_LIMITS["lines"]} AS host_ok FROM h, q)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
