import numpy as np

from tessera.llm import url_filter as u

URLS = [
    (1, "http://a.net/x", ""),
    (2, "https://Sub.Example.NET/en/1?q#f", None),
    (3, "http://example.net/en", ""),
    (4, "http://example.com/de/x", ""),
    (5, "http://notexample.com/de/x", ""),
    (6, "http://b.org/fr/", ""),
    (7, "http://x.net", ""),
    (8, None, "<a href='http://a.net/'>"),
    (9, "mailto:x", ""),
    (10, "http://a.net?x://y/", ""),
    (11, "http://links-bad.io/1", '<a href="http://A.net/1">x</a><a href=//a.net/2>y</a>'),
    (12, "http://linked.io/1", ""),
    (13, "http://b.org/fr/2", '<a href="https://linked.io/#">x</a> <a href="/local">z</a>'),
    (14, "http://alone.io", ""),
    (14, "http://alone.io", ""),
]


def test_rules_and_propagation(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string, html string")
    rows = {(r.page_id): r for r in u.judge_urls(pages).collect()}
    rules = {k: r.rule for k, r in rows.items()}
    assert rules[1] == "net/" and rules[2] == "example.net/en/" and rules[3] == "net/" and rules[4] == "example.com/de/"
    assert rules[5] is None and rules[6] == "org/fr/" and rules[7] is None and rules[8] is None and rules[10] is None
    assert (rows[2].host, rows[2].path) == ("sub.example.net", "/en/1") and (rows[10].host, rows[10].path) == ("a.net", "")
    assert (rows[9].host, rows[9].path) == ("", "") == (rows[8].host, rows[8].path)
    verdicts = {k: r.verdict for k, r in rows.items()}
    assert verdicts[11] == "block" and verdicts[12] == "allow" and verdicts[14] == "allow" and verdicts[10] == "block"
    assert rows[12].trust > 0 and u.judge_urls(pages).count() == len(URLS)
    assert u.judge_urls(pages.limit(0)).count() == 0


def test_long_chains_and_cycles_match_the_linear_system(spark):
    hosts = [f"h{i}.io" for i in range(10)] + ["bad.net", "b.org"]
    n, bad, good = len(hosts), 10, 11
    links = [(i, i + 1) for i in range(10)] + [(3, 1), (good, 5)]  # h0 is 10 links from bad.net
    page = lambda i: f"http://{hosts[i]}/fr/"
    html = ["".join(f'<a href="http://{hosts[b]}/">' for a, b in links if a == i) for i in range(n)]
    rows = u.judge_urls(spark.createDataFrame([(i, page(i), h) for i, h in enumerate(html)], "page_id long, url string, html string"), tolerance=1e-3).collect()
    a = np.zeros((n, n))
    for x, y in links:
        a[x, y] += 1

    def solved(edges, seed):
        out = edges.sum(1, keepdims=True)
        share = np.divide(edges, out, out=np.zeros_like(edges), where=out > 0)
        return np.linalg.solve(np.eye(n) - 0.85 * share.T, 0.15 * np.eye(n)[seed])

    trust, distrust = solved(a, good), solved(a.T, bad)
    for r in rows:
        assert abs(r.trust - trust[r.page_id]) <= 1e-3 and abs(r.distrust - distrust[r.page_id]) <= 1e-3
        near = abs(distrust[r.page_id] - trust[r.page_id]) <= 1e-3
        assert r.rule or near or r.verdict == ("block" if distrust[r.page_id] > trust[r.page_id] else "allow")
    assert {r.page_id: r.verdict for r in rows}[0] == "block" and distrust[0] > 2e-3
