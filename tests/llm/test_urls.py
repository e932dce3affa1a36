from hearthline.llm import urls
from tests.rows import same

RULES = [("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x/y", "allow"), ("a.com", "/x/y", "allow"), ("b.a.com", "/x", "allow"), ("org", "/p", "allow"), ("org", "/p", "block"), ("a.com", "/x/y/z", "block"), ("deep.b.a.com", "/", "block"), ("COM", "/up", "block")]
URLS = [
    "http://a.com/x/y/z/1", "http://A.com/x/yy", "https://www.a.com/x/y?q", "http://b.a.com/x/y", "http://deep.b.a.com/x", "http://ba.com/x", "ftp://org/p#", "http://z.org/q", "http://com", "http://com/", "http://xcom/x", "no url", None, "",
    "http:///x", "http://a.com/x/y/z/1", "http://a.com.?x", "http://e.com/up", "x://y://a.com/x", "http://a.com/X", "http://é.com/x",
]


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    stop = min([i for i in (rest.find(c, end) for c in "?#") if i >= 0], default=len(rest))
    path = rest[end:stop]
    fit = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in RULES if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    if not fit:
        return host, path, None, "block" if not host else "allow"
    best = max(fit)
    return host, path, best[3].split("/")[0] + best[3][best[3].index("/") :], "block" if best[2] else "allow"


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    out = urls.filter_urls(pages, urls.rule_table(spark, RULES))
    rows = out.collect()
    assert len(rows) == len(URLS) and out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"]), r["url"]


def test_many_nested_rules(spark):
    rules = [("a.com", "/" + "d/" * k, "block" if k % 2 else "allow") for k in range(12)]
    pages = spark.createDataFrame([(k, f"http://s{k % 3}.a.com/" + "d/" * (k % 15)) for k in range(300)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in urls.filter_urls(pages, urls.rule_table(spark, rules)).collect()}
    assert got == {k: "a.com/" + "d/" * min(k % 15, 11) for k in range(300)}


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert urls.filter_urls(pages, urls.rule_table(spark)).count() == 3
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark)).count() == 0
    none = urls.filter_urls(pages, urls.rule_table(spark).limit(0)).collect()
    assert sorted(r["verdict"] for r in none) == ["allow", "allow", "block"]


def test_query(spark, sf, duck):
    same(urls.op4_url_filter(spark, sf), duck, urls.OP4_SQL)
