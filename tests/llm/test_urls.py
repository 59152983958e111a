"""URL vocabulary: weights, escapes, boundaries, rows of every kind; the query and its SQL twin."""

import random
import re

import duckdb
import pyarrow as pa

from tarmac.llm import urls

CASES = {
    "http://casino.net/": "block", "http://x.net/%63asin%6F": "block", "http://x.net/%2563asino": "allow", "http://x.net/%%63asino": "block",
    "http://x.net/CASINO%2dWIN": "block", "http://x.net/écasino": "allow", "http://x.net/casinoж": "allow", "http://x.net/казино-casino": "block",
    "http://x.net/casino%C3%A9": "block", "http://x.net/%4": "allow", "http://x.net/%": "allow", "http://x.net/a%0Acasino": "allow",
    "http://free.net/download": "allow", "http://free-bets.net/": "block", "http://ads-track.net/": "block", "http://cheap-pills.net/": "block",
    "http://x.net/buy/online/free/shop": "block", "http://x.net/free?a=free&b=FREE": "allow", "http://x.net/poker": "allow",
    "http://x.net/poker-poker": "allow", "http://x.net/poker-bingo": "block", "http://x.net/a\ncasino": "block", "casino": "block",
    "http://x.net/" + "a/" * 100_000 + "casino": "block", "http://x.net/" + "casino" * 20_000: "allow", "http://x.net/²casino": "allow",
    "http://shop.casino.org/": "allow", "": "allow", "%63asino": "block",
}


def frame(spark, found):
    return spark.createDataFrame([(i, u, 1, 2) for i, u in found], "page_id long, url string, host int, `a.b` int")


def brute(url):
    low = re.sub("%([0-9a-f]{2})", lambda m: (c if re.match("[a-z0-9._~-]", c := chr(int(m[1], 16)).lower()) and int(m[1], 16) < 128 else m[0]),
                 "".join(c.lower() if "A" <= c <= "Z" else c for c in url))
    words = set(re.findall(r"[^\W_]+", low))                        # every term is one run of letters and digits
    weights = {**urls.SOFT, **dict.fromkeys(urls.STRICT, urls.REJECT)}
    return sum(weights.get(w, 0) for w in words), sum(w in weights for w in words)


def made(n=400):
    rng = random.Random(7)
    terms = [*urls.STRICT[:6], *list(urls.SOFT)[::5], "news", "a", "%63am", "é", "x1"]
    return ["http://h.net/" + "".join(rng.choice(terms) + rng.choice(["-", "/", "", "_", "%2E", "ß", "."]) for _ in range(rng.randrange(6))) for _ in range(n)]


def test_verdicts_weights_and_twin(spark):
    found = list(enumerate([*CASES, *made(), "http://casino.net/", None]))
    found += [found[0], found[-1], (None, "http://casino.net/")]     # repeated rows and no id
    rows = urls.judge(frame(spark, found)).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(found)
    assert [(u[:40], got[i].verdict) for i, u in enumerate(CASES)] == [(u[:40], v) for u, v in CASES.items()]
    assert [(got[i].weight, got[i].n_terms) for i, u in found if i is not None] == [brute(u or "") for i, u in found if i is not None]
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": pa.array([i for i, _ in found], pa.int64()), "url": pa.array([u for _, u in found], pa.string())}))
    cur = con.execute(urls.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in rows))) == sorted(map(str, cur.fetchall()))
    assert urls.judge(frame(spark, [])).count() == 0


def test_no_soft_term_rejects_alone():
    assert all(0 < w < urls.REJECT for w in urls.SOFT.values()) and not set(urls.STRICT) & set(urls.SOFT)
    assert len(urls.SOFT) == sum(map(len, urls.SOFT_TERMS.values()))
    assert all(re.fullmatch("[a-z0-9]+", t) for t in (*urls.STRICT, *urls.SOFT))
