"""URL filters whose rules are found by their rarest literal token.

A rule is compiled to a regular expression and to the literal tokens (runs of a-z, 0-9) that every URL it
fits must contain as whole tokens.  Token counts over all URLs choose each rule's rarest token; a join of
the URLs' tokens with that index fetches the candidate rules, and only those run their expressions.
Rules without a usable token run on every URL.

Two forms of rules:

* ``Site(host, path, verdict)`` fits the host, its subdomains, and paths that start with ``path``.  The
  longest rule (host and path together) wins.
* ``Pattern(text, verdict)`` is matched against the lower-cased URL: ``||`` at the start stands for the
  beginning of the host or of one of its labels, ``*`` for any characters, ``^`` for one character that
  is not a letter or digit, or for either end.  It counts only where no site rule fits; block wins.

Defined results: a null URL, or one without ``://``, has an empty host and path, and no rule fits a null
URL.  URLs are judged once however often they occur, and repeated pages give repeated rows.  Where
nothing fits, the verdict is ``allow``.  An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES = 200_000  # rules; beyond it the index is joined by a shuffle
EVERY = ""  # the token of rules that have none of their own


@dataclass(frozen=True)
class Site:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"^(?:[^/]*\.)?{_quoted(self.name)}"

    @property
    def tokens(self) -> list[str]:
        found = [(m.group(), m.end()) for m in re.finditer("[a-z0-9]+", self.name)]
        # the last token may go on in the URL unless something follows it in the rule
        return sorted({t for t, end in found if end < len(self.name)})


@dataclass(frozen=True)
class Pattern:
    text: str
    verdict: str

    @property
    def name(self) -> str:
        return self.text

    @property
    def regex(self) -> str:
        body, start = (self.text[2:], r"^[^:]*://(?:[^/?#]*\.)?") if self.text.startswith("||") else (self.text, "")
        piece = {"*": ".*", "^": "(?:^|[^a-z0-9]|$)"}
        return "(?s)" + start + "".join(piece.get(c) or _quoted(c) for c in body)

    @property
    def tokens(self) -> list[str]:
        anchored = self.text.startswith("||")
        body = self.text[2:] if anchored else self.text
        found = []
        for m in re.finditer("[a-z0-9]+", body):
            before = body[m.start() - 1] if m.start() else ("." if anchored else "*")
            after = body[m.end()] if m.end() < len(body) else "*"
            if before != "*" and after != "*":
                found.append(m.group())
        return sorted(set(found))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


# fixed values: the contract's rules
SITES = (
    Site("net", "/", "block"),
    Site("example.net", "/en/", "allow"),
    Site("example.com", "/de/", "block"),
    Site("org", "/fr/", "allow"),
)
PATTERNS = (
    Pattern("||spam-farm.*", "block"),
    Pattern("^casino^", "block"),
    Pattern("^viagra^", "block"),
    Pattern("^porn^", "block"),
    Pattern("^xxx^", "block"),
    Pattern("^phishing^", "block"),
    Pattern("||adserver.*", "block"),
    Pattern("||doubleclick.*", "block"),
    Pattern("/popunder/", "block"),
    Pattern("/malware/", "block"),
    Pattern("||xn--*", "block"),
)


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(F.col("__rest"), "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(F.col("__rest"), "^[^/?#]*([^?#]*)", 1)
    rows = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    return rows.withColumns({"host": host, "path": path}).drop("__rest")


def _with_tokens(urls: DataFrame) -> DataFrame:
    tokens = F.array_distinct(F.split(F.translate("url", UPPER, LOWER), "[^a-z0-9]+"))
    return urls.withColumn("token", F.explode(F.concat(F.array_remove(tokens, ""), F.array(F.lit(EVERY)))))


def fitting_rules(urls: DataFrame, sites=SITES, patterns=PATTERNS) -> DataFrame:
    """(url, rule, verdict, site, length) for every rule that fits one of the distinct ``urls``.

    ``urls`` has url, host and path.
    """
    spark = urls.sparkSession
    rules = [*sites, *patterns]
    schema = "rule string, verdict string, site boolean, length int, regex string, token string"
    held = [
        (r.name, r.verdict, isinstance(r, Site), len(r.name), r.regex, t) for r in rules for t in (r.tokens or [EVERY])
    ]
    listed = spark.createDataFrame(held, schema)
    small = len(rules) <= BROADCAST_RULES
    mark = F.broadcast if small else (lambda df: df)
    tokens = _with_tokens(urls)
    counted = tokens.join(mark(listed.select("token").distinct()), "token").groupBy("token").count()
    index = (
        listed.join(counted, "token", "left")
        .groupBy("rule", "verdict", "site", "length", "regex")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("rule", "verdict", "site", "length", "regex", F.col("rarest.token").alias("token"))
    )
    subject = F.when(F.col("site"), F.concat("host", "path")).otherwise(F.translate("url", UPPER, LOWER))
    found = tokens.join(mark(index), "token").filter(F.rlike(subject, F.col("regex")))
    return found.select("url", "rule", "verdict", "site", "length")


def verdicts(urls: DataFrame, sites=SITES, patterns=PATTERNS) -> DataFrame:
    """One row per distinct URL that a rule fits: url, rule (longest site rule), pattern, verdict."""
    fits = fitting_rules(urls, sites, patterns)
    longest = F.max(F.when(F.col("site"), F.struct("length", "rule", "verdict")))
    pattern = F.min(F.when(~F.col("site"), F.struct(F.col("verdict") != "block", F.col("rule").alias("rule"), "verdict")))
    best = fits.groupBy("url").agg(longest.alias("s"), pattern.alias("p"))
    return best.select(
        "url",
        F.col("s.rule").alias("rule"),
        F.when(F.col("s").isNull(), F.col("p.rule")).alias("pattern"),
        F.coalesce("s.verdict", "p.verdict").alias("verdict"),
    )


def url_query(pages: DataFrame) -> DataFrame:
    rows = parsed(pages.select("page_id", "url"))
    judged = verdicts(rows.select("url", "host", "path").filter(F.col("url").isNotNull()).distinct())
    return rows.join(judged, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "pattern"
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same rows by plain SQL that tries every rule on every URL."""
    site = "greatest(" + ", ".join(
        f"CASE WHEN regexp_matches(host || path, {_sql_text(s.regex)}) THEN {_sql_text(f'{len(s.name):06d} {s.verdict} {s.name}')} ELSE '' END"
        for s in SITES
    ) + ")"
    pattern = "least(" + ", ".join(
        f"CASE WHEN regexp_matches(low, {_sql_text(p.regex)}) THEN {_sql_text(p.name)} END" for p in sorted(PATTERNS, key=lambda p: p.name)
    ) + ")"
    return f"""
        WITH rest AS (SELECT page_id, url, translate(url, '{UPPER}', '{LOWER}') AS low,
                 CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        found AS (SELECT *, {site} AS s, {pattern} AS p FROM parts)
        SELECT page_id, host, path, CASE WHEN s <> '' THEN split_part(s, ' ', 3) END AS rule,
               CASE WHEN s <> '' THEN split_part(s, ' ', 2) WHEN p IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
               CASE WHEN s = '' THEN p END AS pattern
        FROM found"""
