r"""URL filters (operator 1), with DataFrame functions only.

A rule is a pattern over host and path. `||` at its start anchors at the host or after one of the
host's dots, `*` stands for any characters, `^` for a separator (any character but an ASCII letter
or digit) or either end; everything else is literal. Without `||` a pattern fits anywhere.

Every rule is filed under its rarest literal token: of the runs of ASCII letters and digits that
the pattern bounds on both sides, the one that the fewest URLs of the table hold. A URL's tokens
fetch candidate rules by a join on the token, and only those candidates run their regular
expression. Rules without such a token cannot be filed; they run against every URL.
Of the fitting rules the lowest class wins, then the longest pattern, then the least number. A class
that gives the default verdict names no rule in the result.

Rules are a DataFrame (number, class, pattern, verdict, name), so a list of any length works:
up to `max_broadcast` rules, counted first, the index goes to all tasks; beyond, tokens and index
meet by a shuffle on the token. Either join keeps candidates only, so what goes on are the fits,
one narrow row a URL and fitting rule; the best of each different URL is joined back to the rows.
A URL that a third of all rows share is one key of that last join whose other side has one row, so
adaptive execution splits it. Tokens that many URLs hold are no rule's rarest one, unless all of its are.

Results for odd rows: a null URL or one without `://` has an empty host and path and is allowed
by default; repeated rows and ids stay repeated (ties give equal verdicts); a URL of many megabytes is
matched whole; rules that repeat count once; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table

MAX_BROADCAST = 50_000


#: A token that the pattern bounds on both sides; what stands for `^`.
_TOKEN = r"(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])"
_BORDER = "(?:[^A-Za-z0-9]|^|$)"


@dataclass(frozen=True)
class Rule:
    """A pattern, its verdict, and the name to report (none for a rule of the default verdict)."""

    pattern: str
    verdict: str
    name: str | None = None


def rule_tokens(pattern: Column) -> Column:
    """Literal tokens that every fitting URL holds as a whole token; at the start, only `||` bounds one."""
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(1)))


def rule_regex(pattern: Column) -> Column:
    """The pattern as a regular expression over host and path."""
    body = F.regexp_replace(pattern, r"^\|\|", "")
    body = F.regexp_replace(body, r"([\p{ASCII}&&[^A-Za-z0-9*^]])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(_BORDER))
    return F.concat(F.when(F.startswith(pattern, F.lit("||")), r"(?s)^(?:[^/]*\.)?").otherwise("(?s)"), body)


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains, and a prefix of the path."""
    return Rule(f"||{host}{path}" if path else f"||{host}", verdict, f"{host}{path}")


# The rules of the registered query.
RULES = [
    prefix_rule("com", "/en/", "block"),
    prefix_rule("example.com", "/en/7", "allow"),
    prefix_rule("net", "/de/", "allow"),
    prefix_rule("example.net", "/de/8", "block"),
    prefix_rule("org", "/es/", "block"),
]
#: What the default verdict blocks; all else is allowed.
DEFAULT_RULES = [Rule(f"^{name}^", "block") for name in ("spam-farm", "cheap-pills", "casino", "free-download", "adserver", "click-bait")]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda t: t != ""))


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))))


def rule_table(spark: SparkSession, *classes: list[Rule]) -> DataFrame:
    """Lists of rules, the preferred class first, as the table that judge_by() takes. For a few rules: they are literals."""
    rows = [(k, r.pattern, r.verdict, r.name or "") for k, rules in enumerate(classes) for r in rules]
    rows = [(i, *r) for i, r in enumerate(rows)]
    names = ["number", "class", "pattern", "verdict", "name"]
    return literal_rows(spark, names, rows) if rows else literal_rows(spark, names, [(0, 0, "", "", "")]).limit(0)


def index_rules(rules: DataFrame, urls: DataFrame, few: bool) -> DataFrame:
    """(token, rule columns) of each rule, under the token that the fewest of `urls` (column tokens) hold; null for rules without one."""
    each = rules.select("number", F.explode("tokens").alias("token"))
    known = each.select("token").distinct()
    # Only tokens of rules are counted, at most one row each and task after the map side.
    held = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(known) if few else known, "token", "left_semi").groupBy("token").count()
    weighed = each.join(held, "token", "left").select("number", "token", F.coalesce("count", F.lit(0)).alias("n"))
    rarest = weighed.groupBy("number").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return rules.drop("tokens").join(rarest, "number", "left")


def judge_by(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", max_broadcast: int = MAX_BROADCAST, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row, by a table of rules (number, class, pattern, verdict, name)."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    held = urls.withColumn("tokens", tokens_of(F.concat("host", "path"))).where(F.size("tokens") > 0)
    # The place in the order of preference, as one number; equal patterns of a class differ in theirs.
    length = F.least(F.char_length("pattern"), F.lit(65_535))
    place = F.shiftleft(F.col("class").cast("long"), 56) + F.shiftleft((65_535 - length).cast("long"), 40) + F.col("number").cast("long")
    rules = rules.select("number", rule_tokens(F.col("pattern")).alias("tokens"), rule_regex(F.col("pattern")).alias("regex"), F.struct(place.alias("place"), "name", "verdict").alias("rule"))
    few = rules.limit(max_broadcast + 1).count() <= max_broadcast
    filed = index_rules(rules, held.select("tokens"), few)
    index = filed.where("token IS NOT NULL").select("token", "regex", "rule")
    met = held.select("url", "host", "path", F.explode("tokens").alias("token")).join(F.broadcast(index) if few else index, "token")
    loose = filed.where("token IS NULL").select("regex", "rule")
    if not loose.isEmpty():
        # Every URL meets these rules in one of several copies of them, by a hash of the URL.
        copies = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = loose.select("regex", "rule", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        whole = urls.where("host <> '' OR path <> ''").select("url", "host", "path", F.pmod(F.xxhash64("url"), F.lit(copies)).cast("int").alias("copy"))
        met = met.drop("token").unionByName(whole.join(F.broadcast(spread) if few else spread, "copy").drop("copy"))
    best = met.where(F.regexp(F.concat("host", "path"), F.col("regex"))).groupBy("url").agg(F.min("rule").alias("best"))
    judged = urls.join(best, "url", "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.nullif("best.name", F.lit("")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: list[Rule], default_rules: list[Rule], **options) -> DataFrame:
    """The same by two lists: named rules, and those of the default verdict."""
    return judge_by(pages, rule_table(pages.sparkSession, rules, default_rules), **options)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES, DEFAULT_RULES)


_DEFAULT_SQL = " OR ".join(f"regexp_matches(host || path, '(^|[^A-Za-z0-9]){r.pattern.strip('^')}([^A-Za-z0-9]|$)')" for r in DEFAULT_RULES)
_FITS_SQL = " UNION ALL ".join(
    f"SELECT '{r.pattern[2:].partition('/')[0]}' AS h, '/{r.pattern.partition('/')[2]}' AS p, '{r.name}' AS rule, '{r.verdict}' AS verdict" for r in RULES
)
ORACLE_SQL = rf"""
WITH parts AS (
    SELECT page_id, url,
           translate(regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)', 2, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(.*?)://[^/?#]*([^?#]*)', 2, 's') AS path
    FROM pages
), rules AS ({_FITS_SQL}), numbered AS (SELECT *, row_number() OVER () AS n FROM parts), judged AS (
    SELECT n, max_by(rule, length(rule)) AS rule, max_by(r.verdict, length(rule)) AS verdict
    FROM numbered JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_DEFAULT_SQL} THEN 'block' ELSE 'allow' END) AS verdict
FROM numbered LEFT JOIN judged USING (n)
"""
