"""Secret scans through a trigram inverted index (operator 8). DataFrame functions only.

Each rule is a regular expression. From its syntax follow the trigrams that every match must contain,
as a Boolean query: alternatives of sets of trigrams. The index has, for the trigrams that some rule asks
for, the postings (document, trigram). A document's postings are made, intersected with each alternative
and verified by the expression itself in the document's own row: a text that is read once needs no shuffle.
(`postings` gives the index as a table.) Rules without mandatory trigrams scan all texts. The index is
folded to lower case, so it serves rules with and without case, and can only propose too much.

Spans: matches are leftmost and do not overlap within a rule; those whose group is too short are
dropped after matching. Positions count code points, the end is exclusive. Positions are running sums of
lengths, by runs (`running`), so a text with very many spans takes little more than linear time.

Edge cases: null text is the empty text (and stays null when masked); texts of any length are scanned
whole; each row is verified on its own text, whatever its id; repeated rows each give a row; an empty table
gives none; extra columns stay in `scan` and `redact`, but for names that begin with `_secret_`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import common


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def expression(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: A private key's first or last line; its body has no run of five dashes. Without a last line, a key takes what
#: follows of header lines and base64 (lines of 16 characters or more, and a shorter one that is padded), however many
#: there are. Line ends may be escaped, as in JSON. Repeats of groups are possessive: nothing that they take has
#: to be given back, so a match needs no stack, whatever its length.
_KEY = r"-----{} [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:[\r\n\t\x20]++|\\[rn])++"
_HEADERS = f"(?:{_BREAK}[A-Za-z-]++:(?:[^\\r\\n\\\\]++|\\\\[^rn])*+)*+"
_LINES = f"(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{_BREAK}[A-Za-z0-9+/]*+={{1,2}}+[A-Za-z0-9+/]{{0,4}}+)?+"
_BODY = r"[^-]*+(?:-{1,4}+[^-]++)*+"

#: The three base rules, then those that this operator adds. Runs of hexadecimal digits and access
#: keys state their least length in the pattern: a run that is too short can't hide a longer one.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", _KEY.format("BEGIN") + f"(?:{_BODY}{_KEY.format('END')}|{_HEADERS}{_LINES})?"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%-]+:[A-Za-z0-9._%-]{3,}@"),
)
BASE = ("assign", "access", "hex")
_MAX_ALTERNATIVES = 64
#: Characters of the pieces into which texts that have spans are cut for masking.
PIECE = 16_384


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of which every match satisfies one, by having all its trigrams (lower case). An
    empty list: no trigram is mandatory in some way to match."""
    from re import _constants as sre
    from re import _parser

    def both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
        if not a or not b or len(a) * len(b) > _MAX_ALTERNATIVES:
            return a or b
        return list({x | y for x, y in product(a, b)})

    def of_run(run: str) -> list[frozenset[str]]:
        grams = frozenset(run[k : k + 3].lower() for k in range(len(run) - 2))
        return [grams] if grams else []

    def of(nodes) -> list[frozenset[str]]:
        out: list[frozenset[str]] = []
        run = ""
        for op, arg in nodes:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            out, run = both(out, of_run(run)), ""
            if op is sre.SUBPATTERN:
                out = both(out, of(arg[3]))
            elif op is sre.BRANCH:
                ways = [of(b) for b in arg[1]]
                out = both(out, [x for w in ways for x in w] if all(ways) else [])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
                out = both(out, of(arg[2]))
        return both(out, of_run(run))

    return of(list(_parser.parse(pattern)))


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """The index as a table: id, gram for each document and trigram (as its number in the list) that its text contains."""
    return docs.select(F.col(id_col).alias("id"), F.explode(_entries(F.col(text_col), trigrams)).alias("gram")).distinct()


def _entries(text: Column, trigrams: list[str]) -> Column:
    """The postings of one document: the numbers of the trigrams that its text contains."""
    has = lambda low: F.array(*(F.when(F.contains(low, F.lit(g)), F.lit(k)) for k, g in enumerate(trigrams)))
    return F.array_compact(_let(F.lower(F.coalesce(text, F.lit(""))), has))


def candidates(entries: Column, rule: Rule, trigrams: list[str]) -> Column:
    """Whether a document's postings satisfy the rule's query: one alternative with all its trigrams.
    Rules without mandatory trigrams take every document."""
    clauses = trigram_query(rule.pattern)
    has_all = lambda grams: F.size(F.array_intersect(entries, F.array(*(F.lit(trigrams.index(g)) for g in sorted(grams))))) == len(grams)
    out = F.lit(not clauses)
    for grams in clauses:
        out = out | has_all(grams)
    return out


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each place of an array of integers, what `combine` makes of all values before it. Values are
    taken in about the square root of their number of runs, so that no long array is copied for each."""
    none = F.array().cast("array<int>")
    start = F.lit(zero)

    def scan(run: Column, before: Column) -> Column:
        first = F.struct(before.cast("int").alias("at"), none.alias("out"))
        return F.aggregate(run, first, lambda acc, x: F.struct(combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def by_runs(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(v), width), lambda at: F.slice(v, at, F.ceil(F.sqrt(F.size(v))).cast("int")))
        return _let(runs, lambda r: F.flatten(F.zip_with(r, scan(F.transform(r, lambda x: F.aggregate(x, start, combine)), start), scan)))

    return _let(values, lambda v: F.when(F.size(v) > 0, by_runs(v)).otherwise(none))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rule_spans(text: Column, matches: Column, place: int, rule: Rule) -> Column:
    """The spans of one rule: lengths of what is between the matches and of the matches add up to positions."""
    groups = F.regexp_extract_all(text, F.lit(rule.expression), F.lit(rule.group)) if rule.group else matches
    sizes = F.transform(matches, F.length)

    def starts(between: Column) -> Column:
        steps = F.zip_with(F.slice(between, 1, F.size(between) - 1), sizes, lambda b, m: b + m)
        return F.zip_with(running(steps, lambda a, x: a + x, 0), F.slice(between, 1, F.size(between) - 1), lambda s, b: s + b)

    begin = _let(F.transform(F.split(text, rule.expression, -1), F.length), starts)
    spans = F.zip_with(F.zip_with(begin, sizes, lambda s, m: F.struct(s.alias("s"), m.alias("m"))), F.transform(groups, F.length), lambda p, g: F.when(
        g >= rule.least,
        F.struct(p["s"].alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (p["s"] + p["m"]).alias("end")),
    ))
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    return F.when(F.size(matches) > 0, F.array_compact(spans)).otherwise(none)


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with _secret_spans: an array of (start, place, kind, end), by start, then by the rules' order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trigrams = sorted({g for r in rules for grams in trigram_query(r.pattern) for g in grams})
    rows = docs.withColumn("_secret_grams", _entries(F.col(text_col), trigrams))
    rows = rows.withColumns({f"_secret_m{k}": F.when(candidates(F.col("_secret_grams"), r, trigrams), F.regexp_extract_all(text, F.lit(r.expression), F.lit(0))) for k, r in enumerate(rules)})
    spans = [_rule_spans(text, F.col(f"_secret_m{k}"), k, r) for k, r in enumerate(rules)]
    return rows.withColumn("_secret_spans", F.sort_array(F.concat(*spans))).drop("_secret_grams", *(f"_secret_m{k}" for k in range(len(rules))))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span in text_col replaced by `mark`; overlapping and touching spans get one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scan(docs, text_col, rules)
    # a span opens a new gap if it begins after all ends before it; what is kept lies between that end and its start
    ends = running(F.transform("_secret_spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x), -1)
    opens = F.filter(F.zip_with(F.transform("_secret_spans", lambda s: s["start"]), ends, lambda s, e: F.struct(e.alias("e"), s.alias("s"))), lambda x: x["s"] > x["e"])
    cuts = F.when(F.size("_secret_spans") > 0, F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda k: F.substring(text, k * PIECE + 1, F.lit(PIECE))))
    rows = rows.withColumns({"_secret_opens": F.when(F.size("_secret_spans") > 0, opens), "_secret_cuts": cuts})
    last = F.array_max(F.transform("_secret_spans", lambda s: s["end"]))
    kept = F.transform("_secret_opens", lambda x: F.concat(_between(F.greatest(x["e"], F.lit(0)), x["s"]), F.lit(mark)))
    cleaned = F.concat(F.array_join(kept, ""), _between(last, F.length(text)))
    return rows.withColumn(text_col, F.when(F.size("_secret_spans") > 0, cleaned).otherwise(F.col(text_col))).select(*docs.columns)


def _between(start: Column, end: Column) -> Column:
    """The text from start to end, out of its pieces `_secret_cuts` (finding a place in a string takes as long
    as the place is far from its beginning, so pieces are short)."""
    cuts = F.col("_secret_cuts")
    first, last = (F.floor(x / PIECE).cast("int") for x in (start, end))
    piece = lambda k: F.get(cuts, k)
    one = F.substring(piece(first), start - first * PIECE + 1, end - start)
    inner = F.array_join(F.slice(cuts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    several = F.concat(F.substring(piece(first), start - first * PIECE + 1, F.lit(PIECE)), inner, F.substring(piece(last), F.lit(1), end - last * PIECE))
    return F.when(first == last, one).otherwise(several)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    base = F.filter("_secret_spans", lambda s: s["kind"].isin(*BASE))
    counted = [_count(F.col("_secret_spans"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counted, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("_secret_spans")).alias("spans"))


def _sql_spans(rule: Rule, place: int) -> str:
    # SQL's engine needs no stack and knows no possessive repeats: the same rules without them
    plain = lambda x: re.sub(r"([+*?}])\+", r"\1", x) if rule.kind == "private_key" else x
    flags = "'i'" if rule.any_case else "''"
    p = "'" + plain(rule.pattern).replace("'", "''") + "'"
    cut = "'" + plain(rule.expression).replace("'", "''") + "'"
    return f"""
SELECT doc, {place} AS place, '{rule.kind}' AS kind, i, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start_at, length(m[i]) AS size, length(g[i]) AS gsize
FROM (SELECT doc, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc, regexp_extract_all(t, {p}, 0, {flags}) AS m, regexp_extract_all(t, {p}, {rule.group}, {flags}) AS g, string_split_regex(t, {cut}) AS b FROM d))
WHERE length(g[i]) >= {rule.least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
spans AS (SELECT doc, place, kind, start_at, concat_ws(':', kind, start_at::BIGINT, (start_at + size)::BIGINT) AS span FROM found),
per AS (
  SELECT doc, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    string_agg(span, ',' ORDER BY start_at, place) FILTER (place < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start_at, place) AS spans
  FROM spans GROUP BY doc)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc)
"""
