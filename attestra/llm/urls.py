"""URL filter: host and path rules first, then a weighted vocabulary counted by Aho-Corasick.

A strict term carries the whole rejection weight, a soft term a part of it; a url is rejected when the weights of
its distinct terms reach REJECT_AT. A term counts only where no letter, mark or digit touches it on either side, in the
url as it is written; A-Z are lower-cased for the comparison alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = (
    "casino", "casinos", "kasino", "escort", "escorts", "gambling", "hentai", "malware", "phishing", "pills", "porn", "porno", "pornos", "pornografia", "pornographie", "ransomware",
    "spielbank", "viagra", "warez", "xxx", "xvideos", "cialis", "nude", "nudes", "keygen",
)
SOFT = (
    "ads", "adult", "apuestas", "bet", "bets", "betting", "bonus", "cam", "cams", "cheap", "crack", "deal", "deals", "erotic", "erotik", "farm", "free", "gratis", "gratuit", "kredit", "loan", "loans",
    "lottery", "lotto", "poker", "premios", "prestamos", "promo", "rabatt", "sex", "sexe", "sexo", "slots", "spam", "torrent", "track", "win", "winner", "wetten",
)
REJECT_AT = 2
WEIGHTS = {t: REJECT_AT for t in STRICT} | {t: 1 for t in SOFT}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host plus path, and its verdict; null where none fits. A block wins a tie."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):  # the last one written is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def vocabulary_hits(url: Column, weights: dict[str, int] = WEIGHTS) -> Column:
    """Struct of strict_terms, soft_terms (distinct) and occurrences of a url's vocabulary terms."""

    lower = str.maketrans(UPPER, LOWER)  # keeps the length, unlike lower()
    joins = lambda c: c.isalnum() or unicodedata.category(c)[0] == "M"

    @F.pandas_udf("strict_terms int, soft_terms int, occurrences int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for t in weights:
            machine.add_word(t, t)
        machine.make_automaton()
        for urls in batches:
            rows = []
            for u in urls:
                u, seen, n = u or "", set(), 0
                for end, t in machine.iter(u.translate(lower)):
                    a, b = end - len(t), end + 1
                    if (a < 0 or not joins(u[a])) and (b == len(u) or not joins(u[b])):
                        seen.add(t)
                        n += 1
                strict = sum(weights[t] >= REJECT_AT for t in seen)
                rows.append((strict, len(seen) - strict, n))
            yield pd.DataFrame(rows, columns=["strict_terms", "soft_terms", "occurrences"])

    return hits(url)


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """Adds host, path, rule, verdict, strict_terms, soft_terms and occurrences to every row of `df`.

    No shuffle: one pass over the rows, so a hot host costs nothing extra. A null or malformed url has empty host
    and path, no rule, and is judged by the vocabulary alone (null: allow). Columns of `df` with the names of added
    ones are replaced. Repeated rows are judged alike; an empty table gives an empty one.
    """
    own = (*df.columns, "")
    name = max(own, key=len) + "_"  # of no column of df
    host, path = split_url(df[url])
    out = df.withColumns({"host": host, "path": path, name: vocabulary_hits(df[url], weights)})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    hit = lambda c: F.col(name)[c]
    score = hit("strict_terms") * REJECT_AT + hit("soft_terms")
    return out.withColumns({
        "rule": rule,
        "verdict": F.coalesce(verdict, F.when(score >= REJECT_AT, F.lit("block")).otherwise(F.lit("allow"))),
        **{c: hit(c) for c in ("strict_terms", "soft_terms", "occurrences")},
    }).drop(name)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms")


def _seen(terms) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^\\pL\\pM\\pN]){t}($|[^\\pL\\pM\\pN])') AS INT)" for t in terms)


SQL = f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    {_seen(STRICT)} AS strict_terms, {_seen(SOFT)} AS soft_terms FROM a
), c AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM b
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN strict_terms * 2 + soft_terms >= 2 THEN 'block' ELSE 'allow' END AS verdict, strict_terms, soft_terms FROM c
"""
