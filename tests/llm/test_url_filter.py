import random

from patchweave.llm import url_filter as u


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c
    path = ""
    for c in rest[len(host) :]:
        if c in "?#":
            break
        path += c
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host) or r.host == "") and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count(".") + bool(r.host), len(r.path)), default=None)
    return host, path, best.name if best else None, best.verdict if best else default


URLS = [None, "", "no scheme", "http://", "http://COM", "https://a.com/", "https://a.com", "http://example.com/en/x?y#z", "http://www.example.com/en/", "http://WWW.example.COM/en", "ftp://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr/", "http://net/es/", "http://x.net/de/",
        "http://a.org/en/", "http://a.com:80/en/", "http://u@example.com/en/", "x://y://z.com/", "http://exämple.com/en/é", "http://.com/", "http://a..com/", "http://a.com?q=/en/", "http://" + "a." * 500 + "com/" + "b/" * 5000]


def run(spark, urls, rules):
    df = spark.createDataFrame([(k, x, "r", "h") for k, x in enumerate(urls)], "page_id long, url string, rule string, host string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.filter_urls(df, rules, "page_id").collect()}


def test_fixed_rules(spark):
    assert run(spark, URLS, list(u.RULES)) == {k: brute(x, u.RULES) for k, x in enumerate(URLS)}


def test_random_rules_and_both_ways(spark, monkeypatch):
    rng = random.Random(1)
    pick = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    path = lambda: rng.choice(("", "/", "/x", "/x/", "/x/y", "/xy/", "/y/x/"))
    rules = list({(h, p): u.Rule(rng.choice(("allow", "block")), h, p) for h, p in ((pick(), path()) for _ in range(40))}.values())
    urls = [f"http://{pick()}{path()}{rng.choice(('', 'z', '?q', '#f'))}" for _ in range(400)] + URLS
    want = {k: brute(x, rules) for k, x in enumerate(urls)}
    assert run(spark, urls, rules) == want
    monkeypatch.setattr(u, "MAX_BROADCAST_RULES", 0)
    assert run(spark, urls, rules) == want


def test_trailing_dots_both_ways(spark, monkeypatch):
    """An empty label is a label: no rule of the query fits a host with a trailing dot, as in its SQL."""
    rules = [*u.RULES, u.Rule("block", "org.", "/"), u.Rule("block", "", "/all/")]
    urls = ["http://example.com./en/", "http://www.example.com./en/x", "http://com./", "http://net../es/", "http://a.org./", "http://a.org/", "http://example.com./all/", "http://./en/", "http://../all/", "http://example..com/en/", "http://example.com/en/"]
    want = {k: brute(x, rules) for k, x in enumerate(urls)}
    assert run(spark, urls, rules) == want and want[0][2] is None and want[4][2] == "org./"
    monkeypatch.setattr(u, "MAX_BROADCAST_RULES", 0)
    assert run(spark, urls, rules) == want


def test_null_ids_and_repeated_rows_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(None, "http://a.com/x"), (1, "http://net/es/"), (1, "http://net/es/"), (None, None)], "page_id long, url string")
    want = [("a.com", "com/", "allow", None), ("net", "net/es/", "block", 1), ("net", "net/es/", "block", 1), ("", None, "allow", None)]
    for most in (200_000, 0):
        monkeypatch.setattr(u, "MAX_BROADCAST_RULES", most)
        got = [(r.host, r.rule, r.verdict, r.page_id) for r in u.filter_urls(df, list(u.RULES), "page_id").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_random_hosts_with_empty_labels(spark, monkeypatch):
    """Trie, join and brute force agree on hosts with leading, trailing and doubled dots."""
    rng = random.Random(8)
    host = lambda: "".join(rng.choice(("com", "net", "example", "www", ".", ".", "x")) for _ in range(rng.randint(0, 7)))
    rules = [*u.RULES, *{h: u.Rule("block", h, "/") for h in (host() for _ in range(25)) if h and h not in ("com",)}.values()]
    urls = [f"http://{host()}{rng.choice(('/en/', '/es/', '/', ''))}" for _ in range(500)]
    want = {k: brute(x, rules)[:2] for k, x in enumerate(urls)}
    tree = run(spark, urls, rules)
    assert {k: v[:2] for k, v in tree.items()} == want
    monkeypatch.setattr(u, "MAX_BROADCAST_RULES", 0)
    assert run(spark, urls, rules) == tree == {k: brute(x, rules) for k, x in enumerate(urls)}


def test_empty_table_and_rules(spark):
    assert run(spark, [], list(u.RULES)) == {}
    assert run(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}
