import random
from datetime import datetime, timedelta

from siltstone.llm.url_filter import filter_urls

CAPTURES = "page_id bigint, url string, fetched_at timestamp, host string"
ENTRIES = "domain string, category string, action string, listed_at timestamp, extra int"
T0 = datetime(2024, 1, 1)


def brute(captures, entries):
    out = []
    for i, url, at, _ in captures:
        host = url.split("://")[1].split("/")[0].split(":")[0].lower() if url and "://" in url else None
        hits = []
        if host and at:
            for dom, cat in {(d.lower(), c) for d, c, *_ in entries if d and c}:
                if host == dom or host.endswith("." + dom):
                    past = [(t, a) for d, c, a, t, _ in entries if d and d.lower() == dom and c == cat and a in ("add", "remove") and t and t <= at]
                    if past and max(past)[1] == "add":
                        hits.append((-len(dom), cat, dom))
        out.append((i, bool(hits), min(hits)[2] if hits else None, min(hits)[1] if hits else None))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    random.seed(3)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ab.org", "com"]
    captures = [(i, f"https://{random.choice(hosts)}:80/p{i}", T0 + timedelta(days=random.randrange(400)), "h") for i in range(300)]
    captures += [(1000, None, T0, "h"), (1001, "no url", T0, "h"), (1002, "http://a.com/", None, "h"), (None, "http://A.com/", T0, "h"), captures[0]]
    entries = [(random.choice(hosts), random.choice(["spam", "adult"]), random.choice(["add", "add", "remove"]), T0 + timedelta(days=random.randrange(0, 400, 20)), 1) for _ in range(60)]
    entries += [(None, "spam", "add", T0, 1), ("b.org", None, "add", T0, 1), ("b.org", "spam", "bless", T0, 1), ("B.org", "spam", "add", None, 1), entries[0]]
    out = filter_urls(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert sorted(((r.page_id, r.blocked, r.domain, r.category) for r in out.collect()), key=str) == brute(captures, entries)
    salted = filter_urls(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES), salted=2)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    none = spark.createDataFrame([], ENTRIES)
    assert not any(r.blocked for r in filter_urls(spark.createDataFrame(captures, CAPTURES), none).collect())
    assert filter_urls(spark.createDataFrame([], CAPTURES), none).count() == 0


def test_odd_hosts(spark):
    long = "a." * 2_000 + "b.org"
    captures = [(1, "http://[2001:db8::1]:80/x", T0, "h"), (2, f"http://{long}/", T0, "h"), (3, "http://u:p@B.org./", T0, "h")]
    entries = [("[2001:db8::1]", "spam", "add", T0, 1), ("b.org", "spam", "add", T0, 1)]
    out = filter_urls(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert {r.page_id: (r.host, r.domain) for r in out.collect()} == {1: ("[2001:db8::1]", "[2001:db8::1]"), 2: (long, "b.org"), 3: ("b.org", "b.org")}
