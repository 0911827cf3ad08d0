import pytest

from foliomill.llm import url_trust as U

RULES = sorted(U.RULES, key=lambda r: -len(r[0]))


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    for rule, verdict in RULES:
        at, _, under = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + under):
            return host, path, rule, verdict
    return host, path, None, None


URLS = ["http://A.example.COM/en/1?x#y", "https://www.example.com/en/z", "http://example.com/english", "http://x.net/es/", "http://net/fr/a", "http://notnet/es/", "http://x.org", "http://x.org?q=://b.com/", "no url", None, "", "ftp://É.com/É", "http://x.com", "http://x.com/"]


def test_rules(spark):
    frame = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in U.judge(frame).collect()}
    for k, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (found[k]["host"], found[k]["path"], found[k]["rule"]) == (host, path, rule), u
        assert verdict is None or found[k]["verdict"] == verdict
        assert found[k]["verdict"] in ("allow", "block")


def rank(hosts, edges, seeds, damping=U.DAMPING, rounds=400):
    total = sum(seeds.values())
    start = {h: seeds.get(h, 0) / total for h in hosts}
    out = {}
    for (s, _), w in edges.items():
        out[s] = out.get(s, 0) + w
    score = dict(start)
    for _ in range(rounds):
        moved = dict.fromkeys(hosts, 0.0)
        for (s, d), w in edges.items():
            moved[d] += score[s] * w / out[s]
        score = {h: (1 - damping) * start[h] + damping * moved[h] for h in hosts}
    whole = sum(score.values())
    return {h: v / whole for h, v in score.items()}


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    pages = [(1, "http://good.com/a", link("friend.org", "good.com")), (2, "http://bad.net/es/", link("x.org")), (3, "http://friend.org/", link("pal.org")), (4, "http://pal.org/", ""), (5, "http://farm.org/", link("bad.net", "bad.net")), (6, "http://x.org/", None), (7, "http://farm.org/", link("bad.net"))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["host"]: r for r in U.judge(frame).collect()}
    hosts = {h for h in found}
    edges = {("good.com", "friend.org"): 1, ("bad.net", "x.org"): 1, ("friend.org", "pal.org"): 1, ("farm.org", "bad.net"): 3}
    trust, distrust = rank(hosts, edges, {"good.com": 1}), rank(hosts, {(b, a): w for (a, b), w in edges.items()}, {"bad.net": 1})
    for h in hosts:
        assert found[h]["trust"] == pytest.approx(trust[h], abs=1e-4) and found[h]["distrust"] == pytest.approx(distrust[h], abs=1e-4)
    assert {h: found[h]["verdict"] for h in hosts} == {"good.com": "allow", "bad.net": "block", "friend.org": "allow", "pal.org": "allow", "farm.org": "block", "x.org": "allow"}


def test_walks_reach_the_end_of_a_chain_and_pass_hosts_without_pages(spark):
    """Every second host of a chain to a blocked host has no page; the host at its start is thirty links away."""
    names = ["bad.net"] + [f"h{k}.org" for k in range(1, 31)]
    pages = [(0, "http://bad.net/es/", None), (None, "http://h1.org/", '<a href="//bad.net/x">')]
    pages += [(k, f"http://{names[k]}/", f"<a href='http://{names[k - 1]}/'>") for k in range(2, 31)]
    frame = spark.createDataFrame([(*p, "x", 1.0) for p in pages], "page_id long, url string, html string, host string, score double")
    found = {r["host"]: r for r in U.judge(frame).collect()}
    assert set(found) == set(names) and all(found[h]["verdict"] == "block" and found[h]["distrust"] > 0 for h in names)
    through = [(1, "http://good.com/", '<a href="http://none.org/">'), (2, "http://end.org/", '<a href="http://none.org/"><a href="http://bad.net/">'), (3, "http://bad.net/es/", None), (3, "http://bad.net/es/", None)]
    got = U.judge(spark.createDataFrame(through, "page_id long, url string, html string"))
    rows = {r["host"]: r for r in got.collect()}
    hosts = {"good.com", "none.org", "end.org", "bad.net"}
    edges = {("good.com", "none.org"): 1, ("end.org", "none.org"): 1, ("end.org", "bad.net"): 1}
    distrust = rank(hosts, {(b, a): w for (a, b), w in edges.items()}, {"bad.net": 2})
    assert got.count() == 4 and rows["end.org"]["distrust"] == pytest.approx(distrust["end.org"], abs=1e-4)


def test_empty_and_query(spark, sf_dir):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    found = {r["page_id"]: r for r in U.op5_url_trust(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect():
        host, path, rule, verdict = plain(r["url"])
        f = found[r["page_id"]]
        assert (f["host"], f["path"], f["rule"]) == (host, path, rule) and (verdict is None or f["verdict"] == verdict)
