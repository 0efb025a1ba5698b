"""Operator 9: URL filters whose pattern rules are indexed by their rarest literal token.

Tokens are runs of lower-case letters and digits. Each rule has the literal tokens that any URL which it fits must have;
the one that fewest URLs have is its key. A URL's tokens fetch the rules with those keys, and only their regular
expressions run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table

#: Rules of a host and a path: (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The method's own rules for what no rule above fits: (verdict, pattern over host and path, literal tokens it needs).
PATTERNS = (
    ("block", r"(?:^|[./-])ads?(?:[./-]|$)", ("ad|ads",)),
    ("block", r"(?:^|[./-])(?:casino|porn|xxx)(?:[./-]|$)", ("casino|porn|xxx",)),
    ("block", r"/wp-login\.php$", ("wp", "login", "php")),
    ("allow", r"(?:^|\.)example\.org/", ("example", "org")),
)
TOKEN = r"[a-z0-9]+"


def compiled(rules=RULES, patterns=PATTERNS) -> list[tuple]:
    """(verdict, rule or None, pattern, tokens): tokens are alternatives joined by |."""
    out = []
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        whole = re.findall(TOKEN, host.lower()) + re.findall(TOKEN + "(?=[^A-Za-z0-9])", path.lower())
        out.append((verdict, rule, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", tuple(whole)))
    return out + [(verdict, None, pattern, tokens) for verdict, pattern, tokens in patterns]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path by the contract."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, re.split(r"[?#]", rest[end:], maxsplit=1)[0]


def tokens_of(host: str, path: str) -> set[str]:
    return set(re.findall(TOKEN, f"{host}{path}".lower()))


class Filter:
    def __init__(self, rules: list[tuple], keys: list[str]) -> None:
        self.index: dict[str, list] = {}
        for key, (verdict, rule, pattern, _) in zip(keys, rules):
            for token in key.split("|"):
                self.index.setdefault(token, []).append((verdict, rule, re.compile(pattern)))

    def __call__(self, url: str | None) -> tuple:
        """(host, path, rule, verdict): the longest rule that fits, else the last pattern that does, else allow."""
        host, path = split_url(url)
        best, verdict = None, "allow"
        for token in tokens_of(host, path):
            for said, rule, pattern in self.index.get(token, ()):
                if rule is not None and best is not None and len(rule) <= len(best):
                    continue
                if rule is None and (best is not None or verdict == "block"):
                    continue  # among patterns a block wins
                if pattern.search(host + path):
                    best, verdict = (rule, said) if rule is not None else (best, said)
        return host, path, best, verdict


def _counted(wanted: list[str]):
    want = set(wanted)

    def step(batch):
        import collections

        n = collections.Counter()
        for url in batch.column("url").to_pylist():
            n.update(want & tokens_of(*split_url(url)))
        return {"token": list(n), "n": list(n.values())} if n else None

    return step


def _judged(rules, keys):
    judge = Filter(rules, keys)

    def step(batch):
        found = [judge(x) for x in batch.column("url").to_pylist()]
        return {"page_id": batch.column("page_id").cast("int64")} | {c: [x[i] for x in found] for i, c in enumerate(("host", "path", "rule", "verdict"))}

    return step


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, patterns=PATTERNS) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict.

    A null url, or one without ://, has empty host and path, fits nothing and is allowed. Other columns are ignored;
    repeated rows are judged each; an empty table gives no rows. What goes to the driver is one number for each token
    of the rules.
    """
    made = compiled(rules, patterns)
    wanted = sorted({t for _, _, _, tokens in made for x in tokens for t in x.split("|")})
    counts = per_batch(pages, ["url"], "token string, n long", _counted, wanted).groupBy("token").agg(F.sum("n").alias("n"))
    often = {r["token"]: r["n"] for r in counts.collect()}
    keys = [min(tokens, key=lambda x: (sum(often.get(t, 0) for t in x.split("|")), x)) for _, _, _, tokens in made]
    return per_batch(pages, ["page_id", "url"], "page_id long, host string, path string, rule string, verdict string", _judged, made, keys)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"))


ORACLE_OP9 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '(?s)[?#].*$', '') AS path FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host || path, '(?:^|[./-])ads?(?:[./-]|$)|(?:^|[./-])(?:casino|porn|xxx)(?:[./-]|$)|/wp-login\.php$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM judged
"""
