"""URL filter rules, looked up by their rarest literal token.

A rule names a host pattern and the beginning of a path; ``*`` stands for any run
of characters (in a host or in a path).  It fits the host, all subdomains of
it, and every path that goes on behind its own.  A literal token is a whole run of
letters and digits that every fitting URL must hold; a rule is filed under the
one of its tokens that fewest of the given URLs hold.  The tokens of a URL fetch
candidate rules, and only those run as regular expressions.  A rule without a
literal token is a candidate of every URL.  The longest fitting rule wins, ties by
its text.

Judging needs host and path alone, so each distinct pair is judged once, however
often it comes.

Results: a null url, or one without ``://``, has an empty host and path; an empty
url table gives no rows, an empty rule table no rule; repeated rows get equal
answers; a null page_id is kept; other columns are left out by ``judge`` and never
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.common import checked_broadcast, cut_lineage
from firmlens.session import lookup_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that the contract of the query lists.
SITE_RULES = (
    Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"),
)
# The method's own rules, for URLs that no rule of the site fits: words that sell, as parts of a host name.
METHOD_RULES = tuple(
    Rule(pattern.format(word), "", "block")
    for word in ("spam", "casino", "casinos", "pills", "viagra", "bets", "betting", "poker", "porn", "xxx", "replica", "payday")
    for pattern in ("{}.*", "{}-*.*", "*-{}.*", "*-{}-*.*")
)
DEFAULT_VERDICT = "allow"
_RULE = "rule_id int, list string, rule string, length int, verdict string, host_regex string, path_regex string, tokens array<string>"
# Where rules without a literal token are filed, and what every URL then holds.
EVERYWHERE = ""


def with_place(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``: what stands behind the first ``://`` up to ``/``, ``?`` or ``#``, and on up to ``?`` or ``#``."""
    at = F.instr(F.col(url), "://")
    rest = F.coalesce(F.when(at > 0, F.substr(F.col(url), at + 3)), F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    })


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct runs of letters and digits, marked by where they stand."""
    def marked(mark, text):
        return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.concat(F.lit(mark), t))

    return F.array_distinct(F.concat(marked("h:", host), marked("p:", path)))


def rule_tokens(rule: Rule) -> list[str]:
    """Tokens that stand whole in every URL that the rule fits.

    A run beside a ``*`` may go on there, and so may the last run of a path; a host begins behind a dot and ends with the pattern.
    """
    found = [f"h:{m[0]}" for m in re.finditer(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", rule.host)]
    return found + [f"p:{m[0]}" for m in re.finditer(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", rule.path) if m.end() < len(rule.path)]


def _regex(pattern: str) -> str:
    """``pattern`` in the regular expressions of the engine, every character but ``*`` for itself; dots fit line ends too."""
    return "(?s:.*)".join(re.sub(r"([^\w])", r"\\\1", part, flags=re.ASCII) for part in pattern.split("*"))


def rule_table(spark: SparkSession, **lists: Iterable[Rule]) -> DataFrame:
    """Rules of all lists with their regular expressions and literal tokens."""
    rows = []
    for name, rules in lists.items():
        for r in rules:
            r = replace(r, host=r.host.translate(str.maketrans(UPPER, LOWER)))
            host = f"(?:^|\\.){_regex(r.host)}\\z" if r.host else ""
            rows.append((len(rows), name, r.name, len(r.name), r.verdict, host, f"^{_regex(r.path)}", sorted(set(rule_tokens(r)))))
    return spark.createDataFrame(rows, _RULE)


def index_by_rarest(rules: DataFrame, places: DataFrame) -> DataFrame:
    """Each rule once, under ``token``: of its literal tokens the one that fewest places hold (ties by the token)."""
    literal = rules.select("rule_id", F.explode("tokens").alias("token"))
    held = places.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = held.join(checked_broadcast(literal.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    rarest = literal.join(counts, "token", "left").groupBy("rule_id").agg(least.alias("least"))
    return rules.join(rarest, "rule_id", "left").select(*rules.columns, F.coalesce("least.token", F.lit(EVERYWHERE)).alias("token")).drop("tokens")


def fitting(places: DataFrame, index: DataFrame) -> DataFrame:
    """(host, path, list, rule, verdict): each list's longest fitting rule, for each distinct (host, path) that has one."""
    tokens = url_tokens(F.col("host"), F.col("path"))
    if not index.where(F.col("token") == EVERYWHERE).isEmpty():
        tokens = F.array_append(tokens, EVERYWHERE)
    candidates = lookup_join(places.select("host", "path", F.explode(tokens).alias("token")), index, ["token"], "inner")
    fits = candidates.where(F.expr("(host_regex = '' OR host RLIKE host_regex) AND path RLIKE path_regex"))
    # The longest rule first, then the smallest text; small running minima, so a place with many rules needs no room.
    best = fits.groupBy("host", "path", "list").agg(F.min(F.struct((-F.col("length")).alias("rank"), "rule", "verdict")).alias("best"))
    return best.select("host", "path", "list", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: Iterable[Rule] = SITE_RULES, method_rules: Iterable[Rule] = METHOD_RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, and the method's own rule; that one decides where no given rule fits."""
    placed = with_place(pages.select("page_id", "url")).select("page_id", "host", "path")
    places = cut_lineage(placed.select("host", "path").distinct())
    index = cut_lineage(index_by_rarest(rule_table(pages.sparkSession, given=rules, method=method_rules), places))

    def of(name, column):
        return F.max(F.when(F.col("list") == name, F.col(column)))

    judged = fitting(places, index).groupBy("host", "path").agg(
        of("given", "rule").alias("rule"), of("method", "rule").alias("method_rule"),
        F.coalesce(of("given", "verdict"), of("method", "verdict")).alias("verdict"))
    return placed.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "method_rule")


def oracle_sql() -> str:
    """The same rows from the pages view, every rule tried on every URL."""
    def fits(r):
        host = _regex(r.host).replace("'", "''")
        return f"(regexp_matches(host, '(^|\\.){host}$') AND starts_with(path, '{r.path}'))"

    def first(rules, column):
        ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
        return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, column)}'" for r in ordered) + " END"

    return f"""
        WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        placed AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT page_id, coalesce(rest, '') AS rest FROM rest))
        SELECT page_id, host, path, {first(SITE_RULES, "name")} AS rule,
               coalesce({first(SITE_RULES, "verdict")}, {first(METHOD_RULES, "verdict")}, '{DEFAULT_VERDICT}') AS verdict,
               {first(METHOD_RULES, "name")} AS method_rule
        FROM placed"""
