import re
import time

from pyspark.sql import functions as F

from pvspark.llm import urls

LIST = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def split(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def listed(host, path):
    fits = []
    for rule in LIST:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return max(fits, key=len, default=None)


URLS = [
    None,
    "",
    "no scheme.net/",
    "http://A.Example.NET/en/x?q=1#f",
    "http://example.net/de/",
    "http://xexample.net/en/1",
    "https://example.com/de/1?x",
    "https://example.com/De/1",
    "https://a.b.org/fr/",
    "https://a.b.org/fr",
    "http://net?/x",
    "http://host.net#/",
    "://net/",
    "http://u:p@Ä.NET:80/p\nq",
    "a://b://c.net/",
]


def test_list_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("x"))
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    found = {r.page_id: r for r in urls.filter_urls(pages, labels).collect()}
    for k, url in enumerate(URLS):
        host, path = split(url)
        rule = listed(host, path)
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule), url
        assert found[k].verdict == LIST.get(rule, "allow")


def test_mined_rules_against_all_subsets(spark):
    rows = []
    for k in range(400):
        spam, shop = k % 4 == 0, k % 3 == 0
        url = f"https://{'spam' if spam else 'news'}.example.com/{'shop' if shop else 'read'}/{k}"
        rows.append((k, url, spam and shop if k < 300 else None))
    rows.append((300, rows[300][1], None))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    out = urls.filter_urls(df.drop("blocked"), df.select("page_id", "blocked"))
    found = {r.page_id: (r.verdict, r.mined) for r in out.collect()}
    assert out.count() == len(rows)
    for k in range(300, 400):
        expected = "block" if k % 12 == 0 else "allow"
        assert found[k] == (expected, expected)


def test_pruning_and_index(spark):
    labelled = spark.createDataFrame(
        [(["a", "b", "c"], True)] * 30 + [(["a", "d"], False)] * 30 + [(["d"], False)] * 40,
        "tokens array<string>, blocked boolean",
    )
    rules = urls.mine(labelled, urls.Params(support=0.1, confidence=0.9)).collect()
    # {b} and {c} say all that their supersets say, {d} what {a, d} says
    assert sorted((r.antecedent, r.block, r.anchor) for r in rules) == [
        (["b"], True, "b"),
        (["c"], True, "c"),
        (["d"], False, "d"),
    ]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, True)], "page_id long, blocked boolean")
    assert urls.filter_urls(pages, labels).count() == 0


def test_rare_but_sure_hosts_yield_rules(spark):
    rows = [(k, f"https://news.example.com/read/{k}", False) for k in range(1995)]
    rows += [(k, f"https://cheap-pills.example.com/buy/{k}", True) for k in range(1995, 2000)]
    rows += [(2000, "https://cheap-pills.example.com/buy/new", None), (2001, "https://news.example.com/read/new", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    found = {r.page_id: r.verdict for r in urls.filter_urls(df.drop("blocked"), df.select("page_id", "blocked")).collect()}
    assert (found[2000], found[2001]) == ("block", "allow")


def test_long_urls_that_repeat(spark):
    """Forty segments on the same pages are one class, any of its tokens makes the rule fit."""
    long = "/".join("part" + chr(97 + k % 26) * (1 + k // 26) for k in range(40))
    rows = [(k, f"https://farm.example.com/{long}?s={k}", True) for k in range(6)]
    rows += [(k, f"https://news.example.com/read/{k}", False) for k in range(6, 60)]
    rows += [(60, "https://other.example.com/partc/x", None), (61, "https://other.example.com/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    pages, labels = df.drop("blocked"), df.select("page_id", "blocked")
    urls.filter_urls(pages.limit(1), labels).collect()
    start = time.monotonic()
    found = {r.page_id: r.verdict for r in urls.filter_urls(pages, labels).collect()}
    assert time.monotonic() - start < 10
    assert found == {k: "block" if k < 6 or k == 60 else "allow" for k in range(62)}


def test_classes_tell_pages_apart(spark):
    rows = [(["a", "b", "x"], True), (["a", "b", "x"], False), (["a", "b", "y"], True), (["z"], True), ([], False)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    found = {r["token"]: (r["class"], r["freq"]) for r in urls._classes(labelled, 1.5).collect()}
    assert found == {"a": ("a", 3), "b": ("a", 3), "x": ("x", 2)}
