"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

Rules come first and the longest that fits decides.  Other URLs are judged by their terms:
an automaton finds all of them in one scan of the lower-cased URL, in which escaped ASCII
letters (``%70`` for p) are letters again.  A hit counts only between characters that are no
ASCII letters or digits.  The URL is blocked on one strict term, or on at least two distinct
soft ones whose weights reach SOFT_LIMIT.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, ascii_lower, slices

# Fixed values of the query contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
STRICT = (
    "camgirl", "camgirls", "carding", "casino", "casinos", "cracked", "darkweb", "escort", "escorts", "gore", "hentai", "incest", "keygen", "malware", "milf",
    "phishing", "porn", "porno", "pornography", "ransomware", "sexcam", "spam", "spyware", "torrents", "trojan", "viagra", "warez", "xxx",
)
#: Soft terms and their weights: words that ordinary pages use too weigh less.
SOFT = {
    "adult": 1.0, "babes": 1.0, "bet": 1.0, "bets": 1.0, "betting": 1.0, "bonus": 0.5, "buy": 1.0, "cash": 1.0, "cheap": 1.0, "cialis": 1.0, "click": 0.5, "clickbait": 1.0,
    "coupon": 1.0, "crypto": 1.0, "dating": 1.0, "deals": 0.5, "discount": 0.5, "erotic": 1.0, "farm": 1.0, "forex": 1.0, "free": 1.0, "gambling": 1.0, "giveaway": 1.0, "hot": 0.5,
    "jackpot": 1.0, "loan": 1.0, "loans": 1.0, "lottery": 1.0, "lucky": 0.5, "money": 0.5, "naked": 1.0, "nude": 1.0, "payday": 1.0, "pharmacy": 0.5, "pills": 1.0, "poker": 1.0,
    "prize": 1.0, "replica": 1.0, "sex": 1.0, "sexy": 1.0, "singles": 0.5, "slots": 1.0, "weight-loss": 1.0, "win": 1.0, "winner": 0.5,
}
SOFT_LIMIT = 2.0

# The escapes of A-Z and a-z in a lower-cased URL.
_escaped = re.compile("%(4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a])").sub


def plain(url: str) -> str:
    """A URL lower-cased (A-Z), with escaped letters as letters."""
    low = ascii_lower(url)
    return _escaped(lambda m: chr(int(m[1], 16) | 0x20), low) if "%" in low else low


def automaton(strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, terms in ((0, soft), (1, strict)):
        for t in terms:
            a.add_word(t, (kind, t))
    a.make_automaton()
    return a


def terms(url: str, a: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """The distinct soft and strict terms that stand between boundaries."""
    low, found = plain(url), (set(), set())
    part = lambda c: c.isascii() and c.isalnum()
    for end, (kind, t) in a.iter(low):
        start = end - len(t) + 1
        if not (start and part(low[start - 1])) and not (end + 1 < len(low) and part(low[end + 1])):
            found[kind].add(t)
    return found


def _hits(strict: tuple[str, ...], soft: dict[str, float]):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for b in slices(batches, 4096):
            found = [terms(u or "", a) for u in b.column("url").to_pylist()]
            lists = [pa.array([sorted(f[k]) for f in found], pa.list_(pa.string())) for k in (0, 1)]
            weight = pa.array([sum(soft[t] for t in sorted(f[0])) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *lists, weight], names=["page_id", "url", "soft", "strict", "weight"])

    return hits


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, float] = SOFT, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``strict``, ``soft``, ``weight`` for every row.

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    then up to ``?``, ``#`` or the end.  A null url, or one without ``://``, has both empty,
    fits no rule, and is judged by its terms (null: none, so allowed).  Of rules that fit, the
    longest wins.  Repeated rows are kept, other columns ignored, an empty table gives an
    empty result.
    """
    rows = pages.select("page_id", "url")
    found = rows.mapInArrow(_hits(strict, soft), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, soft array<string>, strict array<string>, weight double")
    at = F.locate("://", "url")
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    split = found.withColumn("rest", F.coalesce(rest, F.lit("")))
    split = split.withColumn("host", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)).withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
    rule = verdict = F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    bad = (F.size("strict") > 0) | ((F.size("soft") > 1) & (F.col("weight") >= soft_limit))
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"), "strict", "soft", "weight")


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict")


def judge_sql(pages: str = "pages") -> str:
    """DuckDB SQL for ``digest`` with the default rules and terms."""
    hit = lambda t: f"CAST(coalesce(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'), false) AS INT)"
    low = f"translate(url, '{ASCII_UPPER}', '{ASCII_LOWER}')"
    for c in ASCII_LOWER:
        low = f"replace(replace({low}, '%{ord(c):x}', '{c}'), '%{ord(c) - 32:x}', '{c}')"
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(v, h, p)}'" for v, h, p in ordered) + " END"
    return f"""
WITH a AS (SELECT page_id, url, {low} AS low,
  coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM {pages}),
b AS (SELECT *, {' + '.join(map(hit, STRICT))} AS n_strict, {' + '.join(map(hit, SOFT))} AS n_soft, {' + '.join(f"{w!r} * {hit(t)}" for t, w in SOFT.items())} AS weight FROM a)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
  coalesce({case(lambda v, h, p: v)}, CASE WHEN n_strict > 0 OR (n_soft > 1 AND weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict
FROM b"""
