import random
import re

from tidemark.llm.url_rules import judged_addresses

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.com", "/d", "allow"), ("net", "/", "block")]


def judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/", "https://x.net", "https://x.net/", "https://EXAMPLE.net/en/1?q=/de/", "http://example.net/EN/", "http://a.b.example.com/de/x#y", "http://a.example.com/demo", "http://notexample.com/de/",
    "http://x.org/fr/", "http://x.org/fr", "ftp://x.org://fr/", "http://net:80/", "http://x.net.", "http://.net/", "http://net\n/", "http://x.org/fr/\nx", "http://" + "a." * 40 + "net/" + "p/" * 500, "http://İ.NET/",
]


def test_equals_brute_force(spark):
    r = random.Random(1)
    parts = ["example", "net", "com", "org", "a", "www"]
    urls = URLS + ["http://" + ".".join(r.choices(parts, k=r.randint(1, 4))) + "/" + r.choice(["en/", "de/", "fr/", "d", "", "x/en/"]) + r.choice(["", "?a", "#b"]) for _ in range(300)]
    urls += ["https://hot.example.net/en/1"] * 150
    rows = spark.createDataFrame([(i, u, 1, "x", "y") for i, u in enumerate(urls)], "page bigint, url string, short int, host string, verdict string")
    out = judged_addresses(rows, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls)
    for row in out:
        assert tuple(row.address) == judge(urls[row.page]), urls[row.page]
        assert (row.short, row.host) == (1, "x")


def test_no_rules_no_rows(spark):
    schema = "host string, path string, verdict string"
    rows = spark.createDataFrame([(1, "http://x.net/")], "page bigint, url string")
    none = spark.createDataFrame([], schema)
    assert judged_addresses(rows, none).first().address.verdict == "allow"
    assert judged_addresses(rows.limit(0), spark.createDataFrame(RULES, schema)).collect() == []
    assert judged_addresses(rows, spark.createDataFrame([("net", None, "block")], schema)).first().address.rule is None
