import html as entities
import random
import tracemalloc
from collections import Counter, defaultdict
from html.parser import HTMLParser

from pyspark.sql import functions as F
from threadloom.llm import extraction, urls

PAGE = '<!DOCTYPE html><html><head><title>T {k}</title><script>var t="</p>";</script></head><body><header class="top">Site</header><nav><ul><li><a href="/a">Menu {k}</a></li></ul></nav><div class="ad">Buy {k}</div><div id="cookie-notice">Accept</div><article><h1>Head&amp;line {k}</h1><p>One <b>bold</b>  text\n{k}.<br><p>Two &lt;x&gt; {k}</p><aside>Side</aside><section class="comments"><p>nice!</p></section></article><form>Mail</form><footer>&copy; us</footer></body></html>'
SCHEMA = "page_id bigint, url string, html string, text string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def run(spark, data, settings=extraction.Settings()):
    return {r["page_id"]: r["text"] for r in extraction.extract(frame(spark, data), settings=settings).collect()}


def test_main_text(spark):
    got = run(spark, [(k, f"http://h.example/{k}", PAGE.replace("{k}", str(k)), "x") for k in range(5)])
    assert got == {k: f"Head&line {k}\nOne bold text {k}.\nTwo <x> {k}" for k in range(5)}


def test_without_landmarks(spark):
    page = "<html><body><div><a href='/'>Home</a> <a href='/x'>More</a></div><div>Same words on each page</div><div><p>Own story {k}</p></div></body>"
    got = run(spark, [(k, f"http://plain.example/{k}", page.replace("{k}", str(k)), None) for k in range(6)])
    assert got[3] == "Own story 3"


def test_odd_pages(spark):
    data = [(1, None, None, None), (2, "no host", "", None), (3, "http://h.example", "<p>unclosed <b>x <p>y &am", None), (4, "http://h.example", "plain < text", None), (5, "http://h.example", "<script>never closed", None), (6, "http://h.example", "<article>" + "<p>long text</p>" * 20000, None), (7, "http://h.example", '<p class="a>b', None), (3, "http://h.example", "<p>unclosed <b>x <p>y &am", None)]
    got = run(spark, data)
    assert got[1] == got[2] == got[5] == "" and got[3] == "unclosed x\ny &am" and got[6].count("\n") == 19999
    assert run(spark, []) == {}


def test_copies_without_landmarks(spark):
    page = "<html><body><div>Same words on each page</div><div><p>{}</p></div></body>"
    texts = ["Copied story", "Copied story", "Own story 1", "Own story 2"]
    got = run(spark, [(k, f"http://copies.example/{k}", page.format(t), None) for k, t in enumerate(texts)])
    assert got == dict(enumerate(texts))


def test_fixed_runs_of_small_hosts(spark):
    page = "<html><body><div>Same words on each page</div><div><p>Own story {}</p></div></body>"
    got = run(spark, [(k, f"http://h{k // 2}.example/{k}", page.format(k), None) for k in range(6)])
    assert got == {k: f"Own story {k}" for k in range(6)}


def words(r, n):
    return " ".join("".join(r.choices("bdfgklmnrstv", k=r.randrange(3, 8))) for _ in range(n))


def layout(r):
    """A host's random layout without landmarks: wrappers with meaningless classes, in random order."""
    name = lambda: "".join(r.choices("qxzjw", k=6))
    return {"menu": name(), "box": name(), "legal": name(), "story": name(), "wrap": name(), "order": r.sample(["menu", "box", "legal"], 3), "at": r.randrange(4), "deep": r.randrange(3), "fixed": words(r, 30)}


def page_of(r, x):
    story = [words(r, 6)] + [words(r, r.randrange(12, 60)) for _ in range(r.randrange(1, 6))]
    part = {
        "menu": f'<div class="{x["menu"]}">' + "".join(f'<div><a href="/{words(r, 1)}">{words(r, 2)}</a></div>' for _ in range(r.randrange(2, 6))) + "</div>",
        "box": f'<div class="{x["box"]}">{words(r, 5)}</div>',
        "legal": f'<div class="{x["legal"]}">{x["fixed"]}</div>',
    }
    body = [part[k] for k in x["order"]]
    inner = f'<div class="{x["story"]}"><h2>{story[0]}</h2>' + "".join(f"<p>{p}</p>" for p in story[1:]) + "</div>"
    for _ in range(x["deep"]):
        inner = f'<div class="{x["wrap"]}">{inner}</div>'
    body.insert(x["at"], inner)
    return "<html><body>" + "".join(body) + "</body></html>", "\n".join(story)


class Tree(HTMLParser):
    """Elements as paths of tag and class, with counts and text, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.path, self.counts, self.own, self.link = (), Counter([()]), defaultdict(lambda: [0, 0]), False
        self.runs = []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        else:
            self.path += ((tag, dict(attrs).get("class")),)
            self.counts[self.path] += 1

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.path = self.path[:-1]

    def handle_data(self, data):
        self.runs.append((self.path, data))
        for k in range(len(self.path) + 1):
            self.own[self.path[:k]][self.link] += len(data)


def brute(pages):
    """Main text by full occurrence vectors and every page's text, no sums and no hashes."""
    trees = [Tree(p) for p in pages]
    vector = {p: tuple(t.counts[p] for t in trees) for t in trees for p in t.counts}
    said = {run for t in trees for run in t.runs}
    valid = {v for v in vector.values() if sum(map(bool, v)) >= len(pages) / 2}
    fixed = {run for run in said if tuple(t.runs.count(run) for t in trees) in valid}

    def text(p):
        return sum(t.own[p][0] for t in trees) - sum(len(s) for t in trees for q, s in t.runs if (q, s) in fixed and q[: len(p)] == p)

    at = ()
    while True:
        below = [p for p in vector if len(p) == len(at) + 1 and p[:-1] == at]
        once = [p for p in below if set(vector[p]) <= {0, 1} and sum(vector[p]) >= len(pages) / 2]
        best = max(once, key=text, default=None)
        if best is None or text(best) < text(at) / 2 or any(p[-1][0] in ("h2", "p") for p in below):
            break
        at = best
    return vector, ["\n".join(s for q, s in t.runs if q[: len(at)] == at and (q, s) not in fixed) for t in trees]


def random_hosts(n_hosts, n_pages, seed):
    r = random.Random(seed)
    rows, truth = [], {}
    for h in range(n_hosts):
        x = layout(r)
        for k in range(n_pages):
            page, story = page_of(r, x)
            rows.append((h * 1000 + k, f"https://Host{h}.example/{k}", page, None))
            truth[h * 1000 + k] = story
    return rows, truth


def test_random_layouts_against_brute_force(spark):
    rows, truth = random_hosts(8, 12, 5)
    got = run(spark, rows)
    by_host = defaultdict(list)
    for row in rows:
        by_host[row[1].split("/")[2]].append(row)
    for pages in by_host.values():
        _, said = brute([p[2] for p in pages])
        assert [got[p[0]] for p in pages] == said
    assert got == truth


def test_classes_against_brute_force(spark):
    rows, _ = random_hosts(1, 9, 8)
    vector, _ = brute([r[2] for r in rows])
    made = extraction.tokens(frame(spark, rows).select(urls.host_of(F.col("url")).alias("host"), F.col("page_id").cast("string").alias("page_id"), "html")).where("kind = 1").collect()
    cache = extraction.Elements()
    paths = {}
    for p in vector:
        at = 0
        for tag, cls in p:
            at = cache[at, tag, f'class="{cls}"' if cls else ""][0]
        paths[extraction.signed(at)] = p
    assert {r["path"] for r in made} == set(paths)
    assert {r["path"]: (r["pages"], r["total"]) for r in made} == {k: (sum(map(bool, vector[p])), sum(vector[p])) for k, p in paths.items()}
    sums = {r["path"]: (r["v1"], r["v2"]) for r in made}
    for a in paths:
        for b in paths:
            assert (sums[a] == sums[b]) == (vector[paths[a]] == vector[paths[b]])
    groups = extraction.classes({r["path"]: r.asDict() for r in made})
    for p, (_, slot) in groups.items():
        up = paths[p][:-1]
        while paths[p] and up and vector[up] == vector[paths[p]]:
            up = up[:-1]
        assert slot is None if not paths[p] or vector[()] == vector[paths[p]] else paths[slot] == up


def test_repeated_rows_add(spark):
    rows, truth = random_hosts(1, 6, 9)
    assert run(spark, rows + rows + rows[:2]) == truth


def test_the_template_decides(spark):
    """On the driver's pages names of elements are not needed, and without a template most pages change."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    text = lambda **k: {r["page_id"]: r["text"] for r in extraction.extract(pages, settings=extraction.Settings(**k)).collect()}
    usual = text()
    assert text(labels=False) == usual
    cache = extraction.Elements()
    whole = {r["page_id"]: extraction.main_text(r["html"], (extraction.Decision(),), extraction.Settings(), cache) for r in pages.collect()}
    assert sum(whole[k] != usual[k] for k in usual) > 0.9 * len(usual)
    for r in pages.collect():  # the articles as they were written
        article = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert usual[r["page_id"]] == extraction.main_text(article, (extraction.Decision(),), extraction.Settings(), cache)


def test_deep_pages_take_linear_memory():
    page = "<div>" * 50_000 + "deep" + "</p>" * 50_000
    tracemalloc.start()
    _, seen = extraction.page_tokens(extraction.scan(page, extraction.Elements()))
    assert extraction.main_text(page, (), extraction.Settings(), extraction.Elements()) == "deep"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) == 50_002 and peak < 100 << 20


def test_references_and_space():
    text = "<p>a &eacute;&#x1F600; \n\t b&nbsp;c</p>"
    assert extraction.main_text(text, (), extraction.Settings(), extraction.Elements()) == " ".join(entities.unescape("a &eacute;&#x1F600; b&nbsp;c").split())
