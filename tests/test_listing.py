"""Listing pages: labels, nearest titles against a walk over the tree, dot segments in links."""

import random
import re

import pytest

from marketloom import session
from marketloom.functions import urls
from marketloom.operators import html, listing
from pyspark.sql import functions as F

RFC_BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, section 5.4, in the strict reading.
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s",
    "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references_as_rfc_3986_resolves_them(spark):
    rows = spark.createDataFrame([(RFC_BASE, h) for h in RFC], "base string, href string")
    got = {r.href: r.target for r in rows.select("href", urls.absolute(F.col("base"), F.col("href")).alias("target")).collect()}
    assert got == RFC
    bare = spark.createDataFrame([("http://a", "../x/./y"), ("http://a?q", "z"), ("http://a/b", None)], "base string, href string")
    assert [r[0] for r in bare.select(urls.absolute(F.col("base"), F.col("href"))).collect()] == ["http://a/x/y", "http://a/z", None]


def walked(page):
    """Prices with their titles by a walk over the tree for every pair: (entry, title, href)."""
    root = html.parse(page)
    nodes = list(root.walk())
    number = {id(n): k for k, n in enumerate(nodes)}

    def text(n, clear=False):
        return " ".join("".join(c if isinstance(c, str) else "" if c.tag in listing.UNSEEN or clear and listing._struck(c) else text_raw(c, clear) for c in n.children).split())

    def text_raw(n, clear):
        return "".join(c if isinstance(c, str) else "" if c.tag in listing.UNSEEN or clear and listing._struck(c) else text_raw(c, clear) for c in n.children)

    shaped = lambda t: "đ" in t and any(c.isdigit() for c in t) and not t.strip("0123456789.,đ ")
    original = lambda n: any(w in n.classes for w in ("line", "old", "del")) or n.tag in ("del", "s") or "line-through" in n.attrs.get("style", "")
    kids = lambda n: [c for c in n.children if isinstance(c, html.Node)]
    out = []
    for n in nodes:
        if not shaped(text(n, True)) or not all(original(c) for c in kids(n) if shaped(text(c))):
            continue
        for up in n.ancestors()[1:6]:
            marks = (up.attrs.get("id", "") + "\n" + up.classes).lower()
            layout = up.tag in urls.LAYOUT_TAGS or not any(w in marks for w in ("item", "col-")) and any(w in marks for w in urls.LAYOUT_PARTS)
            if up.parent is None or layout or any(w in marks for w in urls.EXCLUDED_PARTS):
                break
            inside = [x for x in up.walk() if x is not up]
            named = lambda x: 0 if any(w in x.classes.lower() for w in ("title", "name")) else 1
            good = [x for x in inside if x.tag in listing.HEADINGS and 8 <= len(text(x)) < 150 and not shaped(text(x)) and not any(w in text(x).lower() for w in listing.TRASH)]
            if not good:
                continue
            best = min(good, key=lambda x: (html.dom_distance(n, x), named(x), number[id(x)]))
            link = next((a.attrs.get("href", "") for a in best.ancestors()[:3] if a.tag == "a"), "")
            if not link:
                links = [x for x in inside if x.tag == "a" and len(x.attrs.get("href", "")) > 2 and not x.attrs["href"].startswith(("#", "javascript:"))]
                link = min(links, key=lambda x: (html.dom_distance(n, x), number[id(x)])).attrs["href"] if links else None
            out.append((number[id(n)], text(best), link))
            break
    return sorted(out)


def random_page(rnd):
    def element(depth):
        tag = rnd.choice(["div", "div", "div", "span", "a", "h3", "p", "section", "del", "b"])
        marks = rnd.choice(["", "", "", "item", "row", "title", "old", "cart", "product-name", "row item"])
        href = f' href="{rnd.choice(["/p/%d" % rnd.randint(1, 9), "#", "x", "../q.html"])}"' if tag == "a" else ""
        inner = "".join(element(depth + 1) for _ in range(rnd.randint(0, 3))) if depth < 7 else ""
        words = rnd.choice(["", "", "1.250.000đ", "990.000đ", "Bếp từ Kocher số %d" % rnd.randint(1, 99), "xem thêm sản phẩm", "ngắn"])
        return f'<{tag} class="{marks}"{href}>{words}{inner}</{tag}>'

    return "<html><body>" + "".join(element(1) for _ in range(3)) + "</body></html>"


def test_nearest_titles_equal_a_walk_for_every_pair(spark):
    rnd = random.Random(11)
    pages = {f"http://s/{k}": random_page(rnd) for k in range(150)}
    table = spark.createDataFrame([*pages.items(), ("http://none", None), ("http://empty", "")], "url string, html string")
    got = {}
    for r in listing.nearest(listing.elements(table)).collect():
        got.setdefault(r.url, []).append((r.position.entry, r.title, r.href))
    want = {u: w for u, p in pages.items() if (w := walked(p))}
    assert {u: sorted(g, key=lambda x: x[0]) for u, g in got.items()} == want
    assert sum(map(len, want.values())) > 100


def test_rows_of_a_task_stay_as_pages_grow_in_number(spark, monkeypatch):
    """Files and tasks are cut by the number of elements, and no task sorts what it is about to send on."""
    rnd = random.Random(5)
    pages = spark.createDataFrame([(f"http://s/{k}", random_page(rnd)) for k in range(60)], "url string, html string")
    want = sorted(map(repr, listing.nearest(listing.elements(pages)).collect()))
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    monkeypatch.setattr(listing, "ROWS_A_FILE", 50)
    nodes = listing.elements(pages)
    tasks = -(-nodes.count() // 100)
    assert tasks > 10 and max(r["count"] for r in nodes.groupBy(F.input_file_name()).count().collect()) <= 50
    for found in (listing.nearest(nodes), listing.offers(pages)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        cuts = {int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)}
        assert cuts == {tasks} and ("SortAggregate" not in plan or plan.count("SortAggregate") == 2 and "min_by" in plan)
    assert sorted(map(repr, listing.nearest(nodes).collect())) == want


def test_labels_nest():
    rows = listing.labelled(html.parse("<div id='a'><p>x<b>y</b></p><br><p>z</p></div>"))
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(0, 5, 0, ""), (1, 5, 1, "div"), (2, 3, 2, "p"), (3, 3, 3, "b"), (4, 4, 2, "br"), (5, 5, 2, "p")]
    assert [r[8] for r in rows[1:]] == ["xyz", "xy", "y", "", "z"]


@pytest.mark.parametrize("before,after,want", [("1.500.000đ", "1.200.000đ", 1_200_000), ("1.200.000đ", "1.500.000đ", 1_200_000)])
def test_offers_keep_the_best_of_a_link(spark, before, after, want):
    item = '<div class="item"><h3>Bếp từ Kocher</h3><span class="old">900.000đ</span><span>{}</span><a href="/p/1">x1</a></div>'
    page = "<body><div class='grid'>" + item.format(before) + item.format(after) + "</div></body>"
    rows = listing.offers(spark.createDataFrame([("http://s/c/1", page)], "url string, html string")).collect()
    assert [(r.title, r.link, r.price, r.is_original) for r in rows] == [("Bếp từ Kocher", "http://s/p/1", want, False)]


def test_selector_index_equals_each_selector_on_each_element():
    rnd = random.Random(7)
    words = ["price", "ins", "amount", "product-price", "x-sale-price-y", "gia", "gia-km", "woocommerce-Price-amount", "other", "current_price", "price-box"]

    def element(depth):
        tag = rnd.choice(["div", "ins", "span", "p"])
        marks = " ".join(rnd.sample(words, rnd.randint(0, 3)))
        return f'<{tag} class="{marks}">' + "".join(element(depth + 1) for _ in range(rnd.randint(0, 2) if depth < 5 else 0)) + f"</{tag}>"

    for _ in range(30):
        nodes = list(html.parse("".join(element(0) for _ in range(4))).walk())[1:]
        assert html._priced(nodes) == [(i, n) for i, s in enumerate(html.PRICE_SELECTORS) for n in nodes if n.fits(s)]
