"""URL filters: host and path rules, then wildcard patterns fetched by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host and path rules of the production run.
SITE_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Patterns of the production run: * any run, ^ a character that is no letter, digit, _ . % or -, or an end.
PATTERNS = (
    "/spam-farm.", ".spam-farm.", "/link-farm.", ".link-farm.", "/casino-", ".casino-", "/casino.", ".casino.", "/free-bets.", ".free-bets.",
    "/cheap-pills.", ".cheap-pills.", "/free-pills.", ".free-pills.", "/ads-track.", ".ads-track.", "/adserver.", ".adserver.", "/adult-", ".adult-",
    "^xxx^", "^porn^", "^warez^", "^payday^loans^", "://*.doubleclick.", "/poker-online", "/torrent-download^",
)


@dataclass(frozen=True)
class Pattern:
    text: str
    regex: str
    tokens: tuple[str, ...]


def compile_pattern(text: str) -> Pattern:
    """The pattern's regular expression and the literals that are whole tokens of every URL it matches."""
    low = text.lower()
    regex = "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|^|$)"}.get(c, re.escape(c) if not c.isalnum() else c) for c in low)
    whole = [m for m in TOKEN.finditer(low) if m.start() > 0 and low[m.start() - 1] != "*" and m.end() < len(low) and low[m.end()] != "*"]
    return Pattern(text, regex, tuple(dict.fromkeys(m[0] for m in whole)))


def read_filter_list(lines: Iterable[str]) -> tuple[dict[str, str], list[str]]:
    """(site rules, patterns) of a filter list in the common format of content blockers.

    ||host^ and ||host/path block a site, with @@ in front they allow it; other lines are patterns, without what follows
    a $. Comments (!), headers ([), rules on page elements (##, #@#) and other exceptions are left out.
    """
    sites: dict[str, str] = {}
    patterns = []
    for line in lines:
        rule = line.strip()
        if not rule or rule[0] in "![" or "##" in rule or "#@#" in rule:
            continue
        verdict = "allow" if rule.startswith("@@") else "block"
        rule = rule.removeprefix("@@").partition("$")[0]
        site = re.fullmatch(r"\|\|([a-z0-9.-]+)(?:\^|(/[^*^|]*))?", rule.lower())
        if site:
            sites[site[1] + (site[2] or "/")] = verdict
        elif verdict == "block" and rule.strip("|*^"):
            patterns.append(rule.replace("||", "://*").strip("|"))
    return sites, patterns


def token_counts(urls: DataFrame, tokens: Iterable[str], url_col: str = "url") -> dict[str, int]:
    """How many URLs of the whole table hold each token of the rule set; as many rows as the rule set has tokens."""
    known = F.array(*[F.lit(t) for t in tokens])
    parts = F.array_distinct(F.split(F.lower(F.col(url_col)), "[^a-z0-9]+"))
    rows = urls.select(F.explode(F.array_intersect(parts, known)).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


class RuleIndex:
    """Site rules by host; patterns by their rarest token; patterns without a whole token are tried on every URL."""

    def __init__(self, sites: dict[str, str], patterns: list[Pattern], counts: dict[str, int]) -> None:
        self.sites: dict[str, list[tuple[str, str]]] = {}
        for rule in sites:
            host, slash, path = rule.partition("/")
            self.sites.setdefault(host, []).append((slash + path, rule))
        self.by_token: dict[str, list[tuple[str, re.Pattern]]] = {}
        for p in patterns:
            rarest = min(p.tokens, key=lambda t: (counts.get(t, 0), t), default="")
            self.by_token.setdefault(rarest, []).append((p.text, re.compile(p.regex, re.DOTALL)))

    def site_rule(self, host: str, path: str) -> str | None:
        best = None
        while True:
            for prefix, rule in self.sites.get(host, ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best)):
                    best = rule
            _, dot, host = host.partition(".")
            if not dot:
                return best

    def pattern(self, url: str) -> str | None:
        low = url.lower()
        fetched = {"", *TOKEN.findall(low)} & self.by_token.keys()
        return min((text for t in fetched for text, regex in self.by_token[t] if regex.search(low)), default=None)


def host_and_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the URL is null or has no ://."""
    at = F.expr(f"instr(`{url_col}`, '://')")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    return df.withColumn("host", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def judge(pages: DataFrame, sites: dict[str, str] | None = None, patterns: Iterable[str] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, pattern.

    The longest site rule that fits decides; without one, the URL is blocked if a pattern matches it (the first in
    alphabetical order is named) and else allowed. The rule set is a parameter and goes to each task whole; the tokens'
    frequencies are counted over all URLs. Two rules of one length never fit the same URL, since both would be its host's
    end and its path's beginning. Null or odd URLs: empty host and path, no rule, patterns as usual ('' for null); URLs of
    any length are read whole; repeated rows are judged each; no rows give no rows; further columns are ignored.
    """
    sites = SITE_RULES if sites is None else sites
    compiled = [compile_pattern(p) for p in dict.fromkeys(patterns)]
    tokens = sorted({t for p in compiled for t in p.tokens})
    index = RuleIndex(sites, compiled, token_counts(pages, tokens, url_col) if tokens else {})

    @F.pandas_udf("rule string, pattern string")
    def decide(url: pd.Series, host: pd.Series, path: pd.Series) -> pd.DataFrame:
        rows = [(index.site_rule(h, p), index.pattern(u or "")) for u, h, p in zip(url, host, path, strict=True)]
        return pd.DataFrame(rows, columns=["rule", "pattern"], dtype="object")

    rows = host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).withColumn("d", decide("url", "host", "path"))
    told = F.create_map(*[F.lit(x) for kv in sites.items() for x in kv]) if sites else F.lit(None).cast("map<string,string>")
    verdict = F.coalesce(told[F.col("d.rule")], F.when(F.col("d.pattern").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("d.rule").alias("rule"), verdict.alias("verdict"), F.col("d.pattern").alias("pattern"))


def judge_sql(sites: dict[str, str] | None = None, patterns: Iterable[str] = PATTERNS) -> str:
    """DuckDB SQL of judge() over the view pages."""
    sites = SITE_RULES if sites is None else sites
    fits = []
    for rule in sorted(sites, key=lambda r: (-len(r), r)):
        host, slash, path = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN '{rule}'")
    first = " ".join(f"WHEN regexp_matches(low, '{compile_pattern(p).regex}', 's') THEN '{p}'" for p in sorted(set(patterns)))
    told = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sites.items())
    return f"""
WITH cut AS (SELECT page_id, lower(coalesce(url, '')) AS low, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT page_id, host, path, CASE {" ".join(fits)} END AS rule, CASE {first} END AS pattern FROM parts)
SELECT page_id, host, path, rule, coalesce(CASE rule {told} END, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern FROM judged"""
