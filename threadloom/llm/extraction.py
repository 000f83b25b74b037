"""Operator 5: main text by equivalence-class template deduction.

Tokens of a page are its elements (an opening and a closing tag, which always occur
alike) and its text runs, each told apart by its path from the root. Tokens of a host's
pages with one occurrence vector (how often on which page) form an equivalence class;
elements of one class that lie in different slots are classes of their own. Classes
that enough pages support nest into the host's template: a class lies in the slot of the
innermost element of another class around it.

The template then says what is text. The main slot is found from the root down: the
once-a-page element of a valid class that holds most of the varying, unlinked text.
What is outside is dropped, whatever its name. Inside, text tokens of valid classes
(fixed runs), slots that are mostly links, and slots that their elements' names
label (asides, forms, comments) are dropped, and all else is kept.

A vector is kept as two sums over pages of hashes times counts, so it is added up in
each task and no host's pages are ever gathered; repeated pages add, they don't cancel.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import urls
from .common import durable, measured_join, ship

ship(__name__)

#: Fixed values of HTML: elements whose content is not text, that have no content, and that are containers.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that a sibling of the same kind closes.
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Elements and words of class, id or role that label a slot inside the main one as something else.
NOT_TEXT = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "search"}
CUES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "footer", "form", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    "alert", "complementary", "contentinfo", "advertorial", "discussion",
}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "hgroup"}
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*(?:>|\Z))", re.S)
MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Za-z]+")
#: Bits of each of a vector's two sums: sums of 2^26 tasks' sums still fit 63 bits.
VECTOR_BITS = 36
ELEMENTS_CACHED = 100_000


@dataclass(frozen=True)
class Settings:
    #: Pages that a class needs, and hosts with fewer use the template of all pages together.
    least_pages: int = 3
    #: Share of pages below which an element is no part of the template; it bounds a template's size.
    least_share: float = 0.01
    #: Share of a host's pages that a valid class must be on.
    support: float = 0.5
    #: Share of a slot's text that the next slot down must hold to be the main one.
    main_share: float = 0.5
    #: Paragraphs beside the next slot end the search if they hold this share.
    beside_share: float = 0.1
    #: Slots with a larger share of link text are menus.
    most_links: float = 0.5
    #: Hosts with fewer pages don't place their main slot outside that of all pages, if they have the latter too.
    own_pages: int = 20
    #: Whether elements' names label slots inside the main one.
    labels: bool = True


class Run:
    """A text run, which no block's tag interrupts: its node, the pieces of its text (not decoded), and the length of those in links."""

    __slots__ = ("linked", "node", "pieces")

    def __init__(self, node: int):
        self.node, self.pieces, self.linked = node, [], 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Page:
    """A scanned page: for each node (0 is the page) its parent, path's hash, name and label; and the text runs."""

    __slots__ = ("labels", "names", "parents", "paths", "runs")

    def __init__(self):
        self.parents, self.paths, self.names, self.labels, self.runs = [-1], [0], [""], [""], []

    def add(self, node: int, text: str, new: bool, link: bool) -> None:
        if new:
            self.runs.append(Run(node))
        self.runs[-1].pieces.append(text)
        self.runs[-1].linked += len(text.strip()) * link


class Elements(dict):
    """Path hash and label of an element from its parent's hash, name and attributes."""

    def __missing__(self, key: tuple[int, str, str]) -> tuple[int, str]:
        from xxhash import xxh3_64_intdigest

        parent, name, attributes = key
        found = set()
        if "=" in attributes and name not in ("html", "body"):
            found = {w.lower() for m in MARKS.finditer(attributes) for w in WORDS.findall(m[1] or m[2] or m[3] or "")}
        label = "main" if name in MAIN else "drop" if name in NOT_TEXT or found & CUES else "header" if name == "header" else ""
        if len(self) >= ELEMENTS_CACHED:
            self.clear()
        got = self[key] = xxh3_64_intdigest(" ".join([name, *sorted(found)]), parent), label
        return got


def scan(page: str, elements: Elements) -> Page:
    """Nodes and text runs of a page in order; time and memory are linear. Bad and cut-off markup is read as browsers do, roughly."""
    out = Page()
    stack, opened = [0], Counter()
    new, link, at = True, False, 0

    def close(k: int) -> None:
        opened.subtract(out.names[n] for n in stack[k:])
        del stack[k:]

    while True:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            out.add(stack[-1], text, new, link)
            new = False
        if not m:
            return out
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or ""
        if name == "a":
            link = not closing
        elif name == "br":
            out.add(stack[-1], " ", new, False)
            new = False
        elif name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name in BLOCKS:
            new = True
            if closing:
                if opened[name]:
                    k = len(stack) - 1
                    while out.names[stack[k]] != name:
                        k -= 1
                    close(k)
                continue
            top = out.names[stack[-1]]
            if top in SELF_CLOSING and top in (name, "p"):
                close(len(stack) - 1)
            path, label = elements[out.paths[stack[-1]], name, attributes]
            out.parents.append(stack[-1])
            out.paths.append(path)
            out.names.append(name)
            out.labels.append(label)
            stack.append(len(out.paths) - 1)
            opened[name] += 1
            link = False
        elif name == "hr":
            new = True


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def token(path: int, text: str) -> int:
    """A text run as a token: its text under its path."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text, path)


COUNT_SCHEMA = "host string, kind byte, path bigint, token bigint, content bigint, parent bigint, name string, label string, pages bigint, total bigint, v1 bigint, v2 bigint, chars bigint, linked bigint"
PAGE, ELEMENT, TEXT = 0, 1, 2


def page_tokens(page: Page) -> tuple[int, dict[tuple, list]]:
    """A page's content (a hash of its text runs in order) and tokens: count, text and linked text inside."""
    from xxhash import xxh3_64

    said = xxh3_64()
    chars, linked = [0] * len(page.paths), [0] * len(page.paths)
    seen: dict[tuple, list] = {}
    for r in page.runs:
        text = r.text()
        n = len(text)
        if n:
            t = token(page.paths[r.node], text)
            said.update(t.to_bytes(8, "big"))
            chars[r.node] += n
            linked[r.node] += min(n, r.linked)
            s = seen.setdefault((TEXT, page.paths[r.node], t), [0, 0, 0, 0, "", ""])
            s[0] += 1
            s[1] += n
    for k in range(len(page.paths) - 1, -1, -1):
        up = page.parents[k]
        s = seen.setdefault((ELEMENT, page.paths[k], 0), [0, 0, 0, page.paths[up] if k else 0, page.names[k], page.labels[k]])
        s[0] += 1
        s[1] += chars[k]
        s[2] += linked[k]
        if k:
            chars[up] += chars[k]
            linked[up] += linked[k]
    return said.intdigest(), seen


def _counts(batches):
    """Tokens by host, summed in the task. Pages are told apart by content too."""
    import pyarrow as pa
    from xxhash import xxh3_128_intdigest

    elements, sums = Elements(), {}
    types = [pa.string(), pa.int8(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 6]
    names = [x.split()[0] for x in COUNT_SCHEMA.split(", ")]
    mask = (1 << VECTOR_BITS) - 1

    def send():
        rows = [(h, k, signed(p), signed(t), signed(d), signed(up), name, label, n, c, v1, v2, chars, linked) for (h, k, p, t, d), (n, c, v1, v2, chars, linked, up, name, label) in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for host, page_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            content, seen = page_tokens(scan(body.as_py() or "", elements))
            v = xxh3_128_intdigest(f"{page_id}", content)
            v1, v2 = v & mask, v >> 64 & mask
            seen[PAGE, 0, 0] = [1, 0, 0, 0, "", ""]
            for (kind, path, t), (count, chars, linked, up, name, label) in seen.items():
                key = host, kind, path, t, content if kind == PAGE else 0
                s = sums.get(key)
                if s is None:
                    sums[key] = [1, count, v1 * count & mask, v2 * count & mask, chars, linked, up, name, label]
                else:
                    s[0] += 1
                    s[1] += count
                    s[2] = s[2] + v1 * count & mask
                    s[3] = s[3] + v2 * count & mask
                    s[4] += chars
                    s[5] += linked
            if len(sums) > 200_000:
                yield send()
    if sums:
        yield send()


def tokens(pages: DataFrame) -> DataFrame:
    """Tokens of ``host, page_id, html`` rows by host: pages by content, elements, and text tokens on two pages or more.

    ``pages``, ``total`` and the vector's sums ``v1, v2`` are over pages. A token's rows
    are summed in each task first, and a hot host's pages are dealt by content.
    """
    mod = F.lit(1 << VECTOR_BITS)
    added = [F.sum("pages").alias("pages"), F.sum("total").alias("total"), (F.sum("v1") % mod).alias("v1"), (F.sum("v2") % mod).alias("v2"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")]
    counts = pages.select("host", "page_id", "html").mapInArrow(_counts, COUNT_SCHEMA)
    sums = counts.groupBy("host", "kind", "path", "token", "content").agg(*added, *(F.min(c).alias(c) for c in ("parent", "name", "label")))
    return sums.where(f"kind <> {TEXT} or pages > 1")


@dataclass(frozen=True)
class Decision:
    """What a template says: the main slot's path (0: the page; None: no template), menus inside it, and fixed runs."""

    region: int | None = None
    menus: frozenset = frozenset()
    fixed: frozenset = frozenset()


def classes(elements: dict[int, dict]) -> dict[int, tuple]:
    """Equivalence class of each element: its vector's sums and its slot, the innermost element around it of another vector."""
    vector = {p: (e["v1"], e["v2"]) for p, e in elements.items()}
    out: dict[int, tuple] = {}
    for p in _down(elements):
        up = elements[p]["parent"]
        # An element with its parent's vector is of its parent's class and lies in that class's slot.
        slot = None if p == 0 else out[up][1] if vector[up] == vector[p] else up
        out[p] = (vector[p], slot)
    return out


def _down(elements: dict[int, dict]) -> list[int]:
    """Paths from the page down, parents first. An element's parent is on no fewer pages, so it is known too."""
    below = defaultdict(list)
    for p, e in elements.items():
        if p:
            below[e["parent"]].append(p)
    order = [0]
    for p in order:
        order += sorted(below[p])
    return order


def deduce(elements: list, fixed: list, n_pages: int, common: Decision | None = None, settings: Settings = Settings()) -> Decision:
    """A template's decision from its elements and text tokens; ``common`` is that of all pages."""
    known = {e["path"]: e for e in elements}
    if 0 not in known:
        return Decision()
    group = classes(known)
    order = _down(known)
    size = Counter(group.values())
    off = defaultdict(float)  # text that does not count: links, fixed runs, and labelled slots
    for x in fixed:
        off[x["path"]] += x["chars"]
    text: dict[int, float] = {}
    below = defaultdict(list)
    for p in reversed(order):
        e = known[p]
        own = max(0.0, e["chars"] - e["linked"] - off[p])
        labelled = settings.labels and e["label"] == "drop"
        text[p] = 0.0 if labelled else own
        if p:
            off[e["parent"]] += own + off[p] if labelled else off[p]
            below[e["parent"]].append(p)
    # A class is valid as a place of the main slot if it is on enough pages, once on each.
    valid = {p for p, e in known.items() if e["pages"] >= settings.support * n_pages and e["total"] == e["pages"] and not (settings.labels and e["label"] == "drop")}
    at, paragraphs = 0, {"p", "pre", "blockquote"}
    while True:
        best = max((p for p in below[at] if p in valid), key=lambda p: (text[p], size[group[p]], known[p]["label"] == "main", p), default=None)
        if best is None or text[best] <= 0 or text[best] < settings.main_share * text[at] or known[best]["name"] in HEADINGS | paragraphs:
            break
        if any(p != best and text[p] > 0 and (known[p]["name"] in HEADINGS or (known[p]["name"] in paragraphs and text[p] >= settings.beside_share * text[at])) for p in below[at]):
            break
        at = best
    if n_pages < settings.own_pages and common and common.region in valid:
        above = at
        while above and above != common.region:
            above = known[above]["parent"]
        at = at if above == common.region else common.region
    menus, todo = set(), list(below[at])
    for p in todo:
        if known[p]["linked"] > settings.most_links * known[p]["chars"]:
            menus.add(p)
        else:
            todo += below[p]
    return Decision(at, frozenset(menus), frozenset(x["token"] for x in fixed))


def by_names(page: Page) -> list[bool]:
    """Nodes kept where there is no template to ask: those below an article or main element, or else all, less labelled ones."""
    inside, dropped = [False], [False]
    for k in range(1, len(page.paths)):
        up, label = page.parents[k], page.labels[k]
        inside.append(inside[up] or label == "main")
        dropped.append(dropped[up] or label == "drop" or (label == "header" and not inside[up]))
    any_main = any(inside[r.node] and not dropped[r.node] and r.text() for r in page.runs)
    return [(i or not any_main) and not d for i, d in zip(inside, dropped, strict=True)]


def by_template(page: Page, decision: Decision, settings: Settings) -> list[bool]:
    """Nodes kept by a decision whose main slot is on the page."""
    region = decision.region
    inside, dropped = [region == 0], [False]
    for k in range(1, len(page.paths)):
        up, path = page.parents[k], signed(page.paths[k])
        inside.append(inside[up] or path == region)
        dropped.append(dropped[up] or (inside[up] and (path in decision.menus or (settings.labels and (page.labels[k] == "drop" or (region == 0 and page.labels[k] == "header"))))))
    return [i and not d for i, d in zip(inside, dropped, strict=True)]


def main_text(html: str | None, decisions: tuple[Decision, ...], settings: Settings, elements: Elements) -> str:
    """Kept runs as blocks: references decoded, white space to one space, joined by newlines.

    The first decision whose main slot is on the page decides; if none is, names do.
    A decision without a template keeps everything.
    """
    page = scan(html or "", elements)
    paths = {signed(p) for p in page.paths}
    decision = next((d for d in decisions if d.region is None or d.region in paths), None)
    fixed: frozenset = frozenset()
    if decision is None:
        keep = by_names(page)
    elif decision.region is None:
        keep = [True] * len(page.paths)
    else:
        keep, fixed = by_template(page, decision, settings), decision.fixed
    kept = (r for r in page.runs if keep[r.node] and not (fixed and signed(token(page.paths[r.node], r.text())) in fixed))
    said = (" ".join(entities.unescape("".join(r.pieces)).split()) for r in kept)
    return "\n".join(b for b in said if b)


def _deduced(common: Decision | None, settings: Settings):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            made = [deduce(r["elements"] or [], r["fixed"] or [], r["n_pages"], common, settings) for r in rows]
            lists = lambda x: pa.array([sorted(v) for v in x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.region for d in made], pa.int64()), lists([d.menus for d in made]), lists([d.fixed for d in made])], names=["host", "region", "menus", "fixed"])

    return run


def templates(pages: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, Decision | None]:
    """Decisions of hosts with enough pages (``host, region, menus, fixed``), and that of all pages together, if they are enough.

    A text token is fixed if it has a valid class's vector: it is wherever that class's
    elements are. Hosts whose pages have fewer than ``least_pages`` distinct contents, of which copies may
    be all, take the tokens that are fixed on half of the hosts with two contents or more.
    """
    made = durable(tokens(pages), "tokens")
    n = made.where(f"kind = {PAGE}").groupBy("host").agg(F.sum("pages").alias("n_pages"), F.count(F.lit(1)).alias("n_contents"))
    n = durable(n, "hosts")
    total = n.agg(F.sum("n_pages").alias("pages"), F.count_if(F.col("n_contents") > 1).alias("hosts")).first()
    n_all = total["pages"] or 0
    least = lambda pages: F.greatest(F.lit(settings.least_pages), F.ceil(pages * settings.least_share))
    column = ["path", "parent", "name", "label", "pages", "total", "v1", "v2", "chars", "linked"]
    elements, mod = made.where(f"kind = {ELEMENT}"), F.lit(1 << VECTOR_BITS)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "chars", "linked")] + [(F.sum(c) % mod).alias(c) for c in ("v1", "v2")] + [F.min(c).alias(c) for c in ("parent", "name", "label")]
    everywhere = elements.groupBy("path").agg(*sums).where(F.col("pages") >= least(F.lit(n_all))).select(*column).collect()
    same = ["host", "pages", "v1", "v2"]
    valid = measured_join(elements.select(*same), n.where("n_contents > 1"), "host", "inner").where(F.col("pages") >= settings.support * F.col("n_pages")).select(*same, "n_contents").distinct()
    text = durable(made.where(f"kind = {TEXT}").select(*same, "path", "token", "chars").join(valid, same).drop("pages", "v1", "v2"), "fixed")
    shared = text.groupBy("path", "token").agg(F.count(F.lit(1)).alias("hosts"), F.sum("chars").alias("chars"))
    shared = shared.where((F.col("hosts") >= settings.support * total["hosts"]) & (F.col("hosts") >= settings.least_pages)).select("path", "token", "chars").collect()
    common = deduce([r.asDict() for r in everywhere], [r.asDict() for r in shared], n_all, None, settings) if n_all >= settings.least_pages else None
    enough = n.where(F.col("n_pages") >= settings.least_pages)
    item = F.collect_list(F.struct(*column)).alias("elements")
    of_host = measured_join(elements, enough.select("host", "n_pages"), "host", "inner").where(F.col("pages") >= least(F.col("n_pages"))).groupBy("host").agg(item)
    own = text.where(F.col("n_contents") >= settings.least_pages).groupBy("host").agg(F.collect_list(F.struct("path", "token", "chars")).alias("fixed"))
    none = F.array(*(F.struct(F.lit(r["path"]).alias("path"), F.lit(r["token"]).alias("token"), F.lit(0).cast("long").alias("chars")) for r in shared)).cast("array<struct<path:bigint,token:bigint,chars:bigint>>")
    rows = enough.join(of_host, "host", "left").join(own, "host", "left").select("host", "n_pages", "elements", F.when(F.col("n_contents") >= settings.least_pages, F.col("fixed")).otherwise(none).alias("fixed"))
    return durable(rows.mapInArrow(_deduced(common, settings), "host string, region bigint, menus array<bigint>, fixed array<bigint>"), "templates"), common


def _extracted(settings: Settings, common: Decision | None):
    def run(batches):
        import pyarrow as pa

        elements, held = Elements(), {}
        for batch in batches:
            page, url, body, host, region, menus, fixed = (batch.column(k) for k in range(7))
            texts = []
            for k in range(batch.num_rows):
                h = host[k].as_py()
                if h not in held:
                    if len(held) > 5000:
                        held.clear()
                    own = () if region[k].as_py() is None else (Decision(region[k].as_py(), frozenset(menus[k].as_py() or ()), frozenset(fixed[k].as_py() or ())),)
                    held[h] = own + ((common,) if common else ())
                texts.append(main_text(body[k].as_py(), held[h], settings, elements))
            yield pa.RecordBatch.from_arrays([page, url, pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings = Settings()) -> DataFrame:
    """``page_id, url, text`` for each page.

    Defined cases: null or empty HTML gives empty text; null URLs and URLs without ``://``
    are one host; hosts with few pages use the template of all pages, those with few
    distinct contents its fixed runs; a page on which neither its host's main slot nor
    that of all pages is, and any page of a table with fewer than ``least_pages``, keeps
    what its elements' names don't label; repeated rows are pages of their own, also
    under one id; other columns are ignored; pages of any length and depth are read in
    linear time; no rows give no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", urls.host_of(F.col("url")))
    made, common = templates(rows.withColumn("page_id", F.col("page_id").cast("string")), settings)
    joined = measured_join(rows, made, "host", "left")
    kind = dict(rows.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "host", "region", "menus", "fixed").mapInArrow(_extracted(settings, common), f"page_id {kind}, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
