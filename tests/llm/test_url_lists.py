import datetime as dt

import pytest

from mediasignals.llm import url_lists as U

DAY = dt.date(2024, 5, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


ENTRIES = [
    ("spam", "domain", "bad.com", day(0), "add"), ("spam", "domain", "bad.com", day(10), "remove"),
    ("spam", "domain", "bad.com", day(50), "add"), ("spam", "domain", "bad.com", day(50), "add"),
    ("spam", "domain", "Same.org", day(3), "add"), ("spam", "domain", "same.org", day(3), "remove"),
    ("pirate", "path", "x.net/a/", day(-400), "add"), ("allow", "domain", "ok.bad.com", day(5), "add"),
    ("spam", "domain", None, day(0), "add"), (None, "domain", "bad.com", day(0), "add"),
]
URLS = [
    "http://bad.com/", "https://WWW.bad.com:80/x?y#z", "http://u@ok.bad.com./p", "http://notbad.com/", "http://x.net/a/b/c",
    "http://x.net/ab", "http://x.net/a", "same.org/", "http://same.org", None, "", "http://", "ftp://x.net/a/" + "d/" * 500,
]


def parts(url):
    import re
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)[^/?#]*([^?#]*)", url or "")
    return (m[1].lower().rstrip("."), m[2]) if m else ("", "")


def brute(url, on):
    host, path = parts(url)
    found = set()
    entries = {(li, k, v.lower(), d, a) for li, k, v, d, a in ENTRIES if li and v}
    for li, k, v in {e[:3] for e in entries}:
        past = sorted((d, a) for x, y, z, d, a in entries if (x, y, z) == (li, k, v) and on is not None and d <= on)
        if host and past and past[-1][1] == "add" and (
            host == v or host.endswith("." + v) if k == "domain" else (host + path).startswith(v)
        ):
            found.add(f"{li}:{v}")
    lists = {x.split(":")[0] for x in found}
    return sorted(found), bool(lists - {"allow"}) and "allow" not in lists


@pytest.fixture
def entries(spark):
    return spark.createDataFrame(ENTRIES, "list string, kind string, value string, day date, action string")


def test_matches_brute_force(spark, entries):
    rows = [(u, day(n)) for u in URLS for n in (-1, 0, 4, 5, 9, 10, 49, 50, 400)] + [("http://bad.com/", None)]
    captures = spark.createDataFrame(rows * 2, "url string, fetched_on date").selectExpr("*", "1 as matches")
    got = U.evaluate(captures, entries).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        assert (r.matches, r.blocked) == brute(r.url, r.fetched_on), r


def test_empty_tables(spark, entries):
    captures = spark.createDataFrame([("http://bad.com/", DAY)], "url string, fetched_on date")
    assert U.evaluate(captures, entries.limit(0)).first().matches == []
    assert U.evaluate(captures.limit(0), entries).count() == 0


def test_paths_keep_their_case_and_pages_match(spark):
    entries = spark.createDataFrame(
        [(k, k, v, DAY, "add") for k, v in (
            ("path", "X.net/Movies/"), ("path", "x.net/Watch/Ab"), ("path", "y.net"), ("path", "é.net/Ü"),
            ("url", "X.net/Page"), ("url", "Z.net"), ("domain", "Big.ORG"),
        )],
        "list string, kind string, value string, day date, action string",
    )
    want = {
        "http://x.net/Movies/1": ["path:x.net/Movies/"], "http://X.NET/Movies/": ["path:x.net/Movies/"],
        "http://x.net/movies/1": [], "http://x.net/Movies": [],
        "http://x.net/Watch/Abc/d": ["path:x.net/Watch/Ab"], "http://x.net/Watch/Ab": ["path:x.net/Watch/Ab"],
        "http://x.net/watch/Abc": [], "http://x.net/Watch/A": [],
        "http://y.net/a": ["path:y.net"], "http://y.net": ["path:y.net"], "http://y.network/": [], "http://a.y.net/": [],
        "http://é.net/Ü1": ["path:é.net/Ü"], "http://é.net/ü1": [],
        "http://x.net/Page?q#f": ["url:x.net/Page"], "http://x.net/page": [], "http://x.net/Page/": [], "http://x.net/Page1": [],
        "http://z.net": ["url:z.net/"], "http://z.net/?q": ["url:z.net/"], "http://z.net/a": [],
        "http://www.bIg.org/A": ["domain:big.org"],
    }
    captures = spark.createDataFrame([(u, DAY) for u in want], "url string, fetched_on date")
    assert {r.url: r.matches for r in U.evaluate(captures, entries).collect()} == want
