import random
import re

import pytest
from courtflow.llm.queries import PATTERNS, SITES
from courtflow.llm.url_filters import judge, pattern_rules, rules_table, site_rules

TOKEN = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]"
EDGE = f"(?:(?<!{TOKEN})(?!{TOKEN})|[\x00-\x2f\x3a-\x60\x7b-\x7f])"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_pattern(pattern, url):
    """Does the URL hold the pattern, letter by letter, without expressions or an index."""
    p, u = low(pattern), low(url)
    if p.startswith("||"):
        m = re.match(r"[^/?#]*?://([^/?#]*)", u)
        begins = [m.start(1)] + [i + 1 for i in range(m.start(1), m.end(1)) if u[i] == "."] if m else []
        p = p[2:]
    elif p.startswith("|"):
        begins, p = [0], p[1:]
    else:
        begins = list(range(len(u) + 1))
    tail = len(p) > 0 and p.endswith("|")
    p = p[:-1] if tail else p

    def goes(i, j):
        if i == len(p):
            return not tail or j == len(u)
        if p[i] == "*":
            return any(goes(i + 1, k) for k in range(j, len(u) + 1))
        if p[i] == "^":
            other = j < len(u) and not re.match(TOKEN, u[j])
            return (other and goes(i + 1, j + 1)) or (j in (0, len(u)) and goes(i + 1, j))
        return j < len(u) and u[j] == p[i] and goes(i + 1, j + 1)

    return any(goes(0, j) for j in begins)


def plain(url, sites, patterns, default="allow"):
    if url is None:
        return "", "", None, None, default
    _, found, rest = url.partition("://")
    host = low(re.match(r"[^/?#]*", rest)[0]) if found else ""
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1] if found else ""
    fits = [
        (len(h + p), len(h), v == "block", low(h) + p, v) for h, p, v in sites
        if (host == low(h) or host.endswith("." + low(h))) and path.startswith(p) and host
    ]
    if fits:
        *_, rule, verdict = max(fits)
        return host, path, rule, None, verdict
    met = [(v == "allow", low(p), v) for p, v in patterns if plain_pattern(p, url)]
    if met:
        return host, path, None, max(met)[1], max(met)[2]
    return host, path, None, None, default


MORE = [
    ("|http://*/x.gif|", "block"), ("track", "block"), ("*ID=^*", "block"), ("||é.org/ü", "block"), ("a.b?c+(d)$[e]{f}\\", "block"), ("||Good.example.", "allow"),
    ("^tail", "block"), ("ends|", "block"), ("|", "never"), ("ref=x|", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://example.com", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.www.Example.COM/EN/1",
    "http://myexample.com/en/1", "ftp://x.net/es/", "http://x.net/fr/?a#b", "http://net/es", "http://x.org?q=/en/", "http://x.org#://y.net/es/", "http://casino-win.org/", "http://casinowin.org/",
    "http://x.free-bets.org/", "http://free-bets.org", "http://q.org/a-pills.html", "http://q.org/apills.html", "http://b.org/?utm_source=feed", "http://example.org/en/?utm_source=feed",
    "http://z.org/x.gif", "https://z.org/x.gif", "http://z.org/TRACKER", "http://z.org/?id=&b", "http://é.org/ü/1", "http://z.org/a.b?c+(d)$[e]{f}\\", "http://good.example.org/track", "tail", "x://z/ends",
    "http://z.org/ends?", "http://u.org:80/track", "http://user@x.net/fr/", "http://z.org/" + "a/" * 3000 + "track", "http://\nz.org/\ntrack", "x://z/r?ref=x", "x://z/r?ref=x\n",
]


def judged(spark, urls, sites, patterns, **more):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    s, p = rules_table(spark, "host string, path string, verdict string", sites), rules_table(spark, "pattern string, verdict string", patterns)
    return sorted(tuple(r) for r in judge(pages, s, p, **more).select("page_id", "host", "path", "rule", "pattern", "verdict").collect())


@pytest.mark.parametrize("index_rules", [20_000, 0])
def test_like_plain(spark, index_rules):
    rnd = random.Random(4)
    words = ["com", "net", "org", "example", "www", "en", "es", "fr", "track", "pills", "casino", "id", "x", "é", "ends", "tail"]
    urls = URLS + ["".join(rnd.choice([rnd.choice(words), rnd.choice(list("./?#:-=&")), "://", "/en/", ".example.com"]) for _ in range(9)) for _ in range(150)]
    sites = SITES + [("", "/", "block"), ("x.org", None, "block"), ("c/om", "/", "block"), ("net", "es", "block"), ("É.org", "/", "allow"), ("net", "/e", "allow"), ("example.net", "/", "odd")]
    usable = [(h, p or "", v) for h, p, v in sites if h and "/" not in h and (not p or p[0] == "/") and v != "odd"]
    patterns = PATTERNS + MORE
    want = [(i, *plain(u, usable, [x for x in patterns if x[1] != "never"])) for i, u in enumerate(urls)]
    assert judged(spark, urls, sites, patterns, index_rules=index_rules) == want


def test_rarest_token_files_a_rule(spark):
    from courtflow.llm.url_filters import filed

    urls = spark.createDataFrame([("http://a.example.com/en/1",)] * 3 + [("http://b.example.com/fr/2",)], "url string")
    s = site_rules(rules_table(spark, "host string, path string, verdict string", [("example.com", "/fr/", "block"), ("example.com", "/f", "block")]))
    p = pattern_rules(rules_table(spark, "pattern string, verdict string", [("/fr", "block"), ("abc*def", "block"), ("||b.example^*/2|", "block"), ("||unseen.b^", "block")]))
    entries = {r.rule: r.entry for r in filed(urls, s.unionByName(p)).collect()}
    assert entries == {"example.com/fr/": "fr", "example.com/f": "com", "/fr": "", "abc*def": "", "||b.example^*/2|": "2", "||unseen.b^": "unseen"}


@pytest.mark.parametrize("index_rules", [20_000, 0])
def test_odd_tables(spark, index_rules):
    pages = spark.createDataFrame([(1, "http://a.com/", "q"), (1, "http://a.com/", "q"), (None, None, None)], "page_id long, url string, rule string")
    for name in ("row", "site", "known", "best", "index", "share", "entry", "token", "rank", "regex"):
        from pyspark.sql import functions as F

        pages = pages.withColumn(name, F.lit("x"))
    s, p = rules_table(spark, "host string, path string, verdict string", SITES), rules_table(spark, "pattern string, verdict string", PATTERNS)
    got = judge(pages, s, p, index_rules=index_rules)
    assert set(got.columns) == set(pages.columns) | {"host", "path", "rule", "pattern", "verdict"} and len(got.columns) == len(set(got.columns))
    assert sorted((str(r.page_id), r.rule, r.verdict, r.best) for r in got.collect()) == sorted([("1", "com/", "allow", "x")] * 2 + [("None", None, "allow", "x")], key=str)
    assert judge(pages.limit(0), s, p, index_rules=index_rules).count() == 0
    assert {r.verdict for r in judge(pages, s.limit(0), p.limit(0), "block", index_rules).collect()} == {"block"}
