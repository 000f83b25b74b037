import random

import numpy as np
import pytest
from threadloom.llm import urls

SCHEMA = "page_id bigint, url string, html string, host string"


def test_rules(spark):
    cases = {
        "https://WWW.Example.ORG/es/1?x=/": ("www.example.org", "/es/1", "example.org/es/", "block"), "http://a.org": ("a.org", "", None, "allow"), "http://a.org/": ("a.org", "/", "org/", "allow"), "http://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://x.com?/fr/": ("x.com", "", None, "allow"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    data = [(i, u, None, "z") for i, u in enumerate(cases)] + [(99, None, None, "z")]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want
    assert got[99]["host"] == "" and urls.filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def brute(seeds, links, damping=0.85, steps=400):
    """Personalised PageRank with a matrix; what hosts without links hold goes back to the seeds."""
    hosts = sorted({h for h, _, _ in seeds} | {h for a, b, _ in links for h in (a, b)})
    at = {h: k for k, h in enumerate(hosts)}
    out = {}
    for kind in ("trust", "distrust"):
        m, seed = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
        for a, b, n in links:
            a, b = (a, b) if kind == "trust" else (b, a)
            m[at[b], at[a]] += n
        ends = m.sum(axis=0) == 0
        m = m / np.where(ends, 1, m.sum(axis=0))
        for h, k, s in seeds:
            seed[at[h]] += s * (k == kind)
        x = seed
        for _ in range(steps):
            x = damping * (m @ x) + (1 - damping + damping * x[ends].sum()) * seed
        out |= {(h, kind): x[at[h]] for h in hosts if x[at[h]] > 0}
    return out


LINKS = [("good", "mid", 3), ("mid", "far", 1), ("mid", "good", 1), ("sus", "bad", 2), ("sus", "mid", 1), ("far", "sus", 1), ("good", "end", 5)]


def test_propagation(spark):
    seeds = [("good", "trust", 1.0), ("bad", "distrust", 0.75), ("lone", "distrust", 0.25)]
    ranking = urls.Ranking(tolerance=1e-2)
    got = urls.propagate(spark.createDataFrame(seeds, "host string, kind string, seed double"), spark.createDataFrame(LINKS, "src string, dst string, n long"), ranking).collect()
    want = brute(seeds, LINKS)
    assert {(r["host"], r["kind"]) for r in got} == set(want) and all(abs(r["score"] - want[r["host"], r["kind"]]) < 0.01 for r in got)
    for kind in ("trust", "distrust"):
        assert abs(sum(r["score"] for r in got if r["kind"] == kind) - 1) < 1e-9


def test_unsettled_scores_are_an_error(spark):
    seeds = spark.createDataFrame([("good", "trust", 1.0)], "host string, kind string, seed double")
    with pytest.raises(RuntimeError):
        urls.propagate(seeds, spark.createDataFrame(LINKS, "src string, dst string, n long"), urls.Ranking(most_steps=4, steps_stored=2))


def test_verdicts_against_brute_force(spark):
    """Pages of linked hosts: trusted and blocked seeds by rules, the rest by whom they link to and who links to them."""
    r = random.Random(4)
    hosts = [f"h{k}.com" for k in range(12)] + ["t1.org", "t2.org", "t3.org", "s1.net", "s2.net"]
    data, edges, count = [], {}, {}
    for k in range(220):
        host = r.choice(hosts)
        bad = host in ("h0.com", "h1.com", "h2.com")
        path = r.choice(["/de/x", "/de/y", "/z"]) if bad else r.choice(["/a", "/b", "/fr/c"] if host == "h5.com" else ["/a", "/b"])
        k_host = hosts.index(host)
        near = ["h0.com", "h1.com", "s1.net"] if host[0] == "s" else [h for h in hosts[:15] if h != host and (hosts.index(h) - k_host) % 15 <= 3]
        to = r.sample(near, r.randrange(3))
        data.append((k, f"https://{host.upper()}{path}", "".join(f'<p><a class="x" href="http://{t}/q">t</a>' for t in to) + '<a href="/own">o</a>', ""))
        for t in to:
            edges[host, t] = edges.get((host, t), 0) + 1
        rule = "allow" if host.endswith("org") or path.startswith("/fr/") else "block" if path.startswith("/de/") else None
        if rule:
            count[host, rule] = count.get((host, rule), 0) + 1
    total = {v: sum(n for (_, x), n in count.items() if x == v) for v in ("allow", "block")}
    seeds = [(h, "trust" if v == "allow" else "distrust", n / total[v]) for (h, v), n in count.items()]
    score = brute(seeds, [(a, b, n) for (a, b), n in edges.items()])
    t = {h: score.get((h, "trust"), 0) * total["allow"] for h in hosts}
    d = {h: score.get((h, "distrust"), 0) * total["block"] for h in hosts}
    got = urls.filter_urls(spark.createDataFrame(data, SCHEMA)).collect()
    seen = set()
    for x in got:
        if x["rule"] is None:
            share = d[x["host"]] / (t[x["host"]] + d[x["host"]] or 1)
            assert abs(share - 0.75) > 0.005 and x["verdict"] == ("block" if share > 0.75 else "allow"), (x["host"], share)
            seen.add(x["verdict"])
    assert len(got) == len(data) and seen == {"allow", "block"}


def test_odd_pages(spark):
    html = '<a href="http://bad.com/x">b</a><a HREF=//bad.com>c</a><a href="/own">d</a>'
    data = [(1, "http://bad.com/de/1", None, ""), (2, "http://sus.net/a", html * 20_000, ""), (3, "http://ok.org/1", '<a href="http://friend.net/">f</a>', ""), (4, "http://friend.net/", "", ""), (4, "http://friend.net/", "", "")]
    got = [(r["page_id"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got) == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (4, "allow")]
