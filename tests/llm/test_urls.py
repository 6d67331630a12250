import random

from surgeline.llm import urls

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_rules(spark):
    cases = [
        ("http://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://m.www.example.com/en/9", "m.www.example.com", "/en/9", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/9", "notexample.com", "/en/9", "com/", "allow"),
        ("x://b.net/es", "b.net", "/es", None, "allow"),
        ("http://com?a://b", "com", "", None, "allow"),
        ("a/b://c.org#://d/", "c.org", "", None, "allow"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("www.example.com/en/", "", "", None, "allow"), ("://", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)] + [(0, cases[0][0], "")], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule")
    got = urls.judge(df, RULES).collect()
    assert len(got) == len(cases) + 1
    for g in got:
        assert (g.host, g.path, g.rule, g.verdict) == cases[g.page_id][1:]
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}


def test_rules_match_plain_search(spark):
    r = random.Random(4)
    rules = [("allow", "com/"), ("block", "a.com/x"), ("allow", "b.a.com/"), ("block", "net"), ("allow", "c.net/y/"), ("block", "c.net/y/z"), ("block", "com/x")]
    urls_ = [f"http://{'.'.join(r.choice('abc') for _ in range(r.randrange(0, 3)))}.{r.choice(['com', 'net', 'org', 'a.com', 'c.net'])}/{r.choice(['', 'x', 'x/1', 'y/', 'y/z', 'y/zz?a=b'])}" for _ in range(300)]
    got = urls.judge(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls_)], "page_id long, url string, html string"), rules).collect()
    for g in got:
        fits = [(len(rule), rule, v) for v, rule in rules for h, slash, rest in [rule.partition("/")] if (g.host == h or g.host.endswith("." + h)) and g.path.startswith(slash + rest)]
        assert (g.rule, g.verdict if fits else None) == (max(fits)[1:] if fits else (None, None)), (g, fits)


def test_propagation(spark):
    link = lambda h: f"<a class=x HREF='http://{h}/x'>"
    rows = [
        (1, "http://bad.net/es/1", None), (2, "http://bad.net/fr/1", "<a href=/deals?x>"), (3, "http://bad.net/en/1", None), (4, "http://farm.org/en/1", link("BAD.net")), (5, "http://good.com/de/", link("fine.org")), (6, "http://fine.org/", "<a href='mailto:x@y.z'><a href='#top'><a href=\"news.html\">"),
        (7, "http://sub.bad.net/de/", None), (8, "http://lone.net/fr/", None), (9, "http://lone.net/de/", None), (10, "http://twin.org/a/b", "<a href='/deals#1'>"), (11, "http://alone.org/", None), (None, None, "<a href=/deals>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df, RULES).collect()}
    assert [got[i].verdict for i in range(1, 12)] == ["block", "block", "block", "block", "allow", "allow", "block", "block", "block", "block", "allow"]
    assert got[6].trust > 0 and got[6].distrust == 0 and got[10].distrust > 0 and got[None].verdict == "allow"
    edges = [(r.src, r.dst, r.w) for r in urls.host_edges(urls.split_url(df)).collect()]
    assert {("twin.org", "/deals", 1.0), ("/deals", "twin.org", 1.0), ("fine.org", "/news.html", 1.0), ("farm.org", "bad.net", 1.0), ("sub.bad.net", "bad.net", 1.0)} <= set(edges)
    # both directions against plain power iterations, which end when both stand still
    seeds = {"trust": {"good.com": 1.0}, "distrust": {"bad.net": 2 / 3, "lone.net": 1 / 3}}
    moves = {"trust": edges, "distrust": [(d, s, w) for s, d, w in edges]}
    score = {k: dict(v) for k, v in seeds.items()}
    for _ in range(urls.TURNS):
        after = {}
        for k in score:
            now = {h: s * (1 - urls.DAMPING) for h, s in seeds[k].items()}
            for s, d, w in moves[k]:
                now[d] = now.get(d, 0) + urls.DAMPING * score[k].get(s, 0) * w / sum(x for a, _, x in moves[k] if a == s)
            after[k] = now
        change = sum(abs(after[k].get(h, 0) - score[k].get(h, 0)) for k in score for h in {*after[k], *score[k]})
        score = after
        if change < urls.STILL:
            break
    assert change < urls.STILL
    for r in got.values():
        assert abs(r.trust - score["trust"].get(r.host, 0)) < 1e-9 and abs(r.distrust - score["distrust"].get(r.host, 0)) < 1e-9


def test_long_pages(spark):
    rows = [(1, "http://a.org/" + "x" * 100_000, "<a href='http://b.net/'> word " * 50_000), (2, "http://b.net/es/", None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert len(got[1].path) == 100_001 and got[1].verdict == "block"


def test_edges_of_hot_places_are_dealt_out(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, f"http://s{i}.org/", "<a href=/style.css>" + "".join(f"<a href='http://s{r.randrange(60)}.org/'>" for _ in range(3))) for i in range(60)]
    rows += [(100 + i, f"http://b{i}.net/es/1", "<a href=/style.css>") for i in range(3)] + [(200, "http://g.com/", "<a href='http://s1.org/'>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    take = lambda: {x.page_id: (x.verdict, x.trust, x.distrust) for x in urls.judge(df, RULES).collect()}
    whole = take()
    monkeypatch.setattr(urls, "EDGES", 5)
    parts = take()
    assert whole.keys() == parts.keys() and any(d > 0 for _, _, d in whole.values())
    assert all(whole[k][0] == parts[k][0] and abs(whole[k][1] - parts[k][1]) + abs(whole[k][2] - parts[k][2]) < 1e-12 for k in whole)
