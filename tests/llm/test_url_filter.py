"""URL verdicts: rules, and link propagation against a dense brute-force walk."""
import numpy as np

from cohortbeam.llm import queries, url_filter

RULES = queries.URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:stop]


def rule_of(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def brute_shares(pages, damping=0.85, rounds=500):
    hosts, edges = {}, {}
    for host, path, links in pages:
        if not host:
            continue
        s = hosts.setdefault(host, [0, 0, 0])
        s[{"allow": 0, None: 1, "block": 2}[rule_of(host, path)[1]]] += 1
        for d in links:
            if d != host:
                hosts.setdefault(d, [0, 0, 0])
                edges[host, d] = edges.get((host, d), 0) + 1
    names = sorted(hosts)
    seed = np.array([hosts[h] for h in names], dtype=float)
    w = np.zeros((len(names), len(names)))
    for (a, b), n in edges.items():
        w[names.index(a), names.index(b)] = n
    out = seed.copy()
    for _ in range(rounds):
        new = np.zeros_like(out)
        for k, m in ((0, w), (1, w), (2, w.T)):
            total = m.sum(axis=1)
            share = np.divide(m, total[:, None], out=np.zeros_like(m), where=total[:, None] > 0)
            came = share.T @ out[:, k]
            whole = seed[:, k].sum()
            back = (whole - came.sum()) / whole if whole else 0
            new[:, k] = (1 - damping) * seed[:, k] + damping * (came + back * seed[:, k])
        out = new
    return {h: (out[i, 2] / out[i].sum() if out[i].sum() else None) for i, h in enumerate(names)}


def test_verdicts_and_propagation(spark):
    def link(*hosts):
        return " ".join(f'<a HREF="https://{h.upper()}/x?y">z</a>' for h in hosts) + '<img src=//cdn.org/i><a href="/in">'
    made = [("http://bad.net/x", link("a.com")), ("https://a.com/", link("bad.net", "bad.net")),
            ("https://a.com/2", link("bad.net", "Bad.net")), ("https://good.org/fr/1", link("b.com")),
            ("https://b.com/?q", link("good.org")), ("HTTP://X.Example.NET/en/1#f", ""),
            ("http://example.net/de/1", None), ("http://s.example.com/de/1", ""), ("http://s.example.com/DE/1", ""),
            ("http://notexample.com/de/1", ""), ("http://net", ""), ("http://net/", ""), (None, link("q.com")),
            ("no address", ""), ("x://u:p@h.net:80/a/b?c#d", "")]
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(made)],
                                  "page_id long, url string, html string, host string").selectExpr(
                                      "page_id", "url", "html", "'x' AS rule", "'x' AS dst", "'x' AS trust")
    rows = url_filter.url_verdicts(pages, RULES).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(made)
    parsed = [(*parts(u), [] if not h else [x.lower() for x in __import__("re").findall(
        r'(?i)(?:https://|//)([a-z.]+)/', h)]) for u, h in made]
    shares = brute_shares(parsed)
    for i, (host, path, _) in enumerate(parsed):
        rule, verdict = rule_of(host, path)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        share = shares.get(host)
        if host:
            assert abs(r.distrust - share) < 1e-3
        assert r.verdict == (verdict or ("block" if share is not None and share > 0.5 else "allow"))
    assert got[1].distrust > 0.2 > got[4].distrust and got[4].verdict == "allow"


def test_query_follows_the_rules(spark, sf):
    rows = queries.QUERIES["op9_url_filter"](spark, sf).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or verdict == r.verdict)


def test_empty_table_and_native_plan(spark, sf):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.url_verdicts(none, RULES).count() == 0
    plan = url_filter.url_verdicts(spark.read.parquet(f"{sf}/pages.parquet"), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_distrust_runs_a_long_way_back(spark):
    """A chain of 40 hosts that ends in a large blocked host, to the fixed point."""
    n = 40
    made = [(f"http://h{i}.com/", f'<a href="http://h{i + 1}.com/">' if i + 1 < n else '<a href="http://bad.net/">') for i in range(n)]
    made += [("http://bad.net/x", "")] * 3000
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(made)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.url_verdicts(pages, RULES).where("host <> 'bad.net'").collect()}
    shares = brute_shares([(f"h{i}.com", "/", [f"h{i + 1}.com" if i + 1 < n else "bad.net"]) for i in range(n)]
                          + [("bad.net", "/x", [])] * 3000)
    assert len(got) == n and all(abs(got[h].distrust - shares[h]) < 1e-2 for h in got)
    assert all(got[h].verdict == ("block" if shares[h] > 0.5 else "allow") for h in got if abs(shares[h] - 0.5) > 1e-2)
    assert got["h0.com"].distrust > 0.5 and got["h15.com"].verdict == "block"


def test_masses_are_kept_and_rounds_dropped(spark):
    hosts = spark.createDataFrame([("a", 1, 0, 5), ("b", 0, 1, 0)], "host string, trust_seed long, neutral_seed long, distrust_seed long")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, weight long")
    rows = url_filter.propagate(hosts, edges).collect()
    assert len(rows) == 2 and abs(sum(r.trust + r.neutral + r.distrust for r in rows) - 7) < 1e-2
