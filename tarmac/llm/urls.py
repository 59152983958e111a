"""URL filters: host and path rules first, then a weighted vocabulary.

A rule names a host and a path prefix; it fits the host and its subdomains.
The longest rule that fits decides. Where none fits, an Aho-Corasick automaton
finds the vocabulary's terms in the url, with A-Z lower-cased and escapes of unreserved
characters (``%61``) read as what they stand for (other escapes stay, and end a word); a hit counts only if it is bounded by
characters other than letters and digits of any script. Strict terms weigh REJECT,
soft terms have weights below it, each distinct term counts once; a url is blocked at
a weight of REJECT or more: one strict term, or several distinct soft terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarmac.llm.common import prepare

# (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
REJECT = 4
# Terms that reject alone.
STRICT = ("adult", "bdsm", "camgirl", "camgirls", "camsex", "casino", "escort", "escorts", "fetish", "hentai", "keygen", "keygens",
          "malware", "milf", "nsfw", "phishing", "porn", "porno", "pornography", "ransomware", "spam", "spyware", "warez", "xxx")
# Soft terms by weight: rarely, often and mostly met in clean urls.
SOFT_TERMS = {
    3: ("bet", "bets", "betting", "bingo", "blackjack", "cialis", "erotic", "gamble", "gambling", "jackpot", "loan", "loans", "lottery",
        "nude", "payday", "pills", "poker", "roulette", "sex", "sexy", "slots", "sportsbook", "torrent", "torrents", "viagra", "wager"),
    2: ("ads", "adserver", "affiliate", "bonus", "cam", "cams", "cheap", "clickbait", "crack", "cracked", "dating", "discount", "doorway",
        "farm", "forex", "hack", "hot", "invest", "linkfarm", "lucky", "pharma", "pharmacy", "popup", "prize", "promo", "replica",
        "serial", "track", "tracker", "tracking", "win", "winner"),
    1: ("buy", "click", "coupon", "credit", "deal", "deals", "download", "free", "mp3", "offer", "online", "sale", "shop", "stream"),
}
SOFT = {term: weight for weight, terms in SOFT_TERMS.items() for term in terms}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for NULL or no ``://``."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


class Vocabulary:
    """Weight of the distinct bounded terms in a url."""

    def __init__(self, strict=STRICT, soft=SOFT, reject: int = REJECT):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for term, weight in {**soft, **dict.fromkeys(strict, reject)}.items():
            self.auto.add_word(term, (term, weight))
        self.auto.make_automaton()

    def weight(self, url: str | None) -> tuple[int, int]:
        """(weight, distinct terms) of a url."""
        if not url:
            return 0, 0
        low, found = plain(url), {}
        for end, (term, weight) in self.auto.iter(low):
            start = end - len(term)
            if (start < 0 or not low[start].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                found[term] = weight
        return sum(found.values()), len(found)


_LOWER = str.maketrans(UPPER, LOWER)
_UNRESERVED = {f"%{ord(c):02x}": c.translate(_LOWER) for c in UPPER + LOWER + "0123456789-._~"}
_ESCAPE = re.compile("%[0-9a-f]{2}")


def plain(url: str) -> str:
    """A url with A-Z lowered and the escapes of unreserved characters replaced, once."""
    low = url.translate(_LOWER)
    return _ESCAPE.sub(lambda m: _UNRESERVED.get(m[0], m[0]), low) if "%" in low else low


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, reject: int = REJECT) -> DataFrame:
    """(page_id, host, path, rule, verdict, weight, n_terms), one row per input
    row. NULL urls and urls without ``://`` have an empty host and path, so no
    rule fits; a NULL url has weight 0 and is allowed. Repeated rows are judged
    one by one; other columns are not read."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(strict, soft, reject)
        for b in batches:
            got = np.array([words.weight(u) for u in b.column(1).to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got[:, 0]), pa.array(got[:, 1])],
                                             names=["page_id", "url", "weight", "n_terms"])

    scored = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
              .mapInArrow(run, "page_id long, url string, weight long, n_terms long"))
    host, path = host_path(F.col("url"))
    split = scored.select("page_id", host.alias("host"), path.alias("path"), "weight", "n_terms")
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("weight") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return split.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                        "weight", "n_terms")


def _oracle() -> str:
    weights = {**SOFT, **dict.fromkeys(STRICT, REJECT)}
    escapes = ", ".join(f"'{k}': '{v}'" for k, v in _UNRESERVED.items())
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    low = f"""CASE WHEN contains(url, '%') THEN array_to_string(list_transform(regexp_extract_all({low}, '(?s)%[0-9a-f]{{2}}|.'),
      lambda x: coalesce(MAP {{{escapes}}}[x], x)), '') ELSE {low} END"""
    hit = lambda t: f"CAST(regexp_matches(low, '(^|[^\\pL\\pN]){t}($|[^\\pL\\pN])') AS INT)"
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in weights.items())
    terms = " + ".join(hit(t) for t in weights)
    fits = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    when = lambda pick: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h + p)}'" for v, h, p in fits)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
             CAST({weight} AS BIGINT) AS weight, CAST({terms} AS BIGINT) AS n_terms FROM (SELECT page_id, url, {low} AS low FROM pages) l),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, weight, n_terms FROM r)
SELECT page_id, host, path, CASE {when(lambda v, t: t)} ELSE NULL END AS rule,
  CASE {when(lambda v, t: v)} WHEN weight >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict, weight, n_terms
FROM h"""


ORACLE_SQL = _oracle()
