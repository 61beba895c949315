"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a site rule (host and start of the path; fits the host and its subdomains) or a
pattern with ``*`` for any characters, matched against host, path and query. Every rule is
filed under one token (a run of ASCII letters and digits) that each matching url must hold
in full: the one that the fewest urls of the table hold. The tokens of a url fetch its
candidate rules, and only those run their regular expressions. Rules without such a token
are candidates for every url.

The longest fitting site rule decides; without one, the longest fitting pattern; without
either, the url is allowed. Results in special cases: a null url, or one without ``://``,
has empty host and path and is allowed; rules of equal length rank by their text; other
columns are ignored; repeated rows give repeated results; an empty table gives an empty one; urls may
have any length, as expressions of the row alone look at them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_INLINE_RULES = 500
TOKEN = "[A-Za-z0-9]+"

#: (host and path, verdict)
SITE_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: (pattern, verdict): pages for logged-in users, shopping, administration, tracked copies
PATTERN_RULES = (
    ("*/login/*", "block"),
    ("*/cart/*", "block"),
    ("*/wp-admin/*", "block"),
    ("*?utm_source=*", "block"),
    ("*?print=*", "block"),
)

RULE_TYPE = "array<struct<rule:string,verdict:string,site:boolean,regex:string,size:int>>"


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_=&-])", r"\\\1", literal)


def compile_rules(sites: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]]) -> list[dict]:
    """Rules with their regular expression and the tokens every matching url must hold in full."""
    rules = []
    for rule, verdict in sites:
        whole = [m for m in re.finditer(TOKEN, rule) if m.end() < len(rule)]
        regex = rf"(?s)\A(?:[^/]*\.)?{_quoted(rule)}.*\z"
        rules.append({"rule": rule, "verdict": verdict, "site": True, "regex": regex, "size": len(rule), "tokens": {m[0] for m in whole}})
    for rule, verdict in patterns:
        tokens = set()
        for m in re.finditer(TOKEN, rule):
            before, after = rule[: m.start()][-1:], rule[m.end() :][:1]
            if before != "*" and after != "*":  # the ends of a pattern are ends of the url
                tokens.add(m[0])
        regex = r"(?s)\A" + ".*".join(map(_quoted, rule.split("*"))) + r"\z"
        rules.append({"rule": rule, "verdict": verdict, "site": False, "regex": regex, "size": len(rule), "tokens": tokens})
    return rules


def split_url(url: str = "url") -> tuple[Column, Column, Column]:
    """Host (A-Z lowered), path, and host + path + query of a url."""
    has = F.coalesce(F.col(url).contains("://"), F.lit(False))
    rest = F.when(has, F.substr(F.col(url), F.locate("://", F.col(url)) + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\A[^?#]*([^#]*)", 1)
    return host, path, F.concat(host, path, query)


def _index(urls: DataFrame, rules: list[dict]) -> list[dict]:
    """File each rule under the token that the fewest urls hold."""
    literals = sorted(set().union(*(r["tokens"] for r in rules)) if rules else [])
    held = {}
    if literals:
        seen = F.array_intersect("_tokens", F.array(*map(F.lit, literals)))
        held = {r[0]: r[1] for r in urls.select(F.explode(seen).alias("t")).groupBy("t").count().collect()}
    return [r | {"token": min(r["tokens"], key=lambda t: (held.get(t, 0), t), default="")} for r in rules]


def _best(fits: Column, site: bool) -> Column:
    """The longest of the fitting rules of one kind."""
    kind = F.filter(fits, lambda r: r["site"] == F.lit(site))
    ranked = F.transform(kind, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(ranked)


def judge_urls(
    pages: DataFrame,
    sites: Sequence[tuple[str, str]] = SITE_RULES,
    patterns: Sequence[tuple[str, str]] = PATTERN_RULES,
    max_inline: int = MAX_INLINE_RULES,
) -> DataFrame:
    """page_id, host, path, rule (of the site rule), verdict, pattern (where it decided).

    Up to ``max_inline`` rules are a map in the plan, and judging is one narrow stage.
    More rules are a table: tokens and rules are joined with the tokens salted, and the
    fitting rules of a distinct url are brought back to its rows.
    """
    host, path, target = split_url()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), target.alias("_target"))
    urls = urls.withColumn("_tokens", F.array_distinct(F.concat(F.regexp_extract_all("_target", F.lit(TOKEN), F.lit(0)), F.array(F.lit("")))))
    rules = _index(urls, compile_rules(sites, patterns))
    judged = _inline(urls, rules) if len(rules) <= max_inline else _joined(urls, rules)
    site, pattern = F.col("_site"), F.col("_pattern")
    return judged.select(
        "page_id",
        "host",
        "path",
        site["rule"].alias("rule"),
        F.coalesce(site["verdict"], pattern["verdict"], F.lit("allow")).alias("verdict"),
        F.when(site.isNull(), pattern["rule"]).alias("pattern"),
    )


def _inline(urls: DataFrame, rules: list[dict]) -> DataFrame:
    filed: dict[str, list[dict]] = {}
    for r in rules:
        filed.setdefault(r["token"], []).append(r)
    lit = lambda r: F.struct(*[F.lit(r[k]).alias(k) for k in ("rule", "verdict", "site", "regex", "size")])
    none = F.array().cast(RULE_TYPE)
    if not filed:
        return urls.withColumn("_site", _best(none, True)).withColumn("_pattern", _best(none, False))
    index = F.create_map(*[x for t, rs in filed.items() for x in (F.lit(t), F.array(*map(lit, rs)))])
    known = F.array_intersect("_tokens", F.array(*map(F.lit, filed)))
    fetched = F.flatten(F.transform(known, lambda t: F.element_at(index, t)))
    fits = F.filter(fetched, lambda r: F.regexp_like(F.col("_target"), r["regex"]))
    return urls.withColumn("_fits", fits).withColumn("_site", _best(F.col("_fits"), True)).withColumn("_pattern", _best(F.col("_fits"), False))


def _joined(urls: DataFrame, rules: list[dict], salts: int = 64) -> DataFrame:
    spark = urls.sparkSession
    schema = "token string, rule string, verdict string, site boolean, regex string, size int"
    table = spark.createDataFrame([tuple(r[k] for k in ("token", "rule", "verdict", "site", "regex", "size")) for r in rules], schema)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    texts = urls.select("_target", "_tokens").groupBy("_target").agg(F.first("_tokens").alias("_tokens"), F.count("*").alias("_n"))
    tokens = texts.select("_target", F.explode("_tokens").alias("token")).withColumn("_salt", F.pmod(F.xxhash64("_target"), F.lit(salts)).cast("int"))
    fits = tokens.join(salted, ["token", "_salt"]).where(F.regexp_like("_target", F.col("regex")))
    rank = F.struct("size", "rule", "verdict")
    best = fits.groupBy("_target").agg(F.max(F.when(F.col("site"), rank)).alias("_site"), F.max(F.when(~F.col("site"), rank)).alias("_pattern"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    spread = urls.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return spread.join(best.withColumn("_salt", every), ["_target", "_salt"], "left")
