"""Stop rules over pages of search results, page by page in plain Python."""

import random

from marketloom.sources import search


def test_stop_rules(spark):
    rnd = random.Random(8)
    rows, asked = [], []
    for product in range(30):
        brand, model = "Kocher", f"DI-{1000 + product}"
        for no, keyword in enumerate(("k0", "k1", "k2")):
            asked.append((brand, model, keyword, no))
            for engine in search.ENGINES:
                for page in range(1, rnd.randint(1, 4)):
                    links = [rnd.choice([f"https://s{rnd.randint(0, 5)}.vn/san-pham/kocher-di-{1000 + product}", f"https://s.vn/tin-tuc/{rnd.randint(0, 9)}", "#x", "/url?q=https://a.vn/san-pham/di-1-x"]) for _ in range(rnd.randint(0, 9))]
                    rows.append((brand, model, keyword, engine, page, links, rnd.random() < 0.1))

    def html(engine, links, refused):
        as_link = {"ddg": '<a class="result__a" href="{}">x</a>', "bing": '<li class="b_algo"><h2><a href="{}">x</a></h2></li>'}.get(engine, '<a href="{}">x</a>')
        return "<body>" + "".join(as_link.format(u) for u in links) + ("detected unusual traffic" if refused else "") + "</body>"

    def target(u):
        return None if u == "#x" else u.removeprefix("/url?q=") if u.startswith("/url?") else u

    def read(product, keyword, engine):
        taken = []
        for page, links, refused in sorted((r[4], r[5], r[6]) for r in rows if r[1] == product and r[2] == keyword and r[3] == engine):
            if page > search.PAGES[engine] or page > 1 and sum("/san-pham/kocher" in u for u in taken) >= 5:
                break
            if refused and engine in search.REFUSALS:
                break
            found = [t for u in links if (t := target(u))]
            taken += found
            if len(found) < 5:
                break
        return taken

    want = set()
    for model in {a[1] for a in asked}:
        seen, order = {}, []
        for no, keyword in enumerate(("k0", "k1", "k2")):
            if sum("/san-pham/kocher" in u for u in order) >= 5:
                break
            for engine in search.ENGINES:
                for u in read(model, keyword, engine):
                    if u not in seen:
                        seen[u] = no
                        order.append(u)
        want |= {(model, u, no) for u, no in seen.items()}
    pages = spark.createDataFrame([(*r[:5], html(r[3], r[5], r[6])) for r in rows], "brand string, model string, keyword string, engine string, page int, html string")
    requests = spark.createDataFrame(asked, "brand string, model string, keyword string, keyword_no int")
    assert {(r.model, r.url, r.keyword_no) for r in search.progressive_links(requests, pages).collect()} == want
    assert any(r.read is False for r in search.read_pages(pages).collect())


def test_category_links_without_their_children(spark):
    """Whole names of categories stay, longer ones of the same beginning go; other sites, home, excluded and unnamed paths never come."""
    from marketloom.operators import links

    page = """<body><a href="/bep-tu">Bếp từ</a><a href='/bep-tu-bosch.html'>Bếp từ Bosch</a><a href=/bep-tu?x=1>lại</a><a href="../may-giat/./lg">Máy giặt LG<a href="/may-giatlg">mg</a>
    <a href="https://khac.vn/bep-tu">Bếp</a><a href="/">Bếp</a><a href="/cart/bep">Bếp</a><a href="#bep">Bếp</a><a href="javascript:bep()">Bếp</a><a href="/x//bep-tu-y">z</a><a href="/xin-moi">xin</a><a>Bếp</a></body>"""
    rows = spark.createDataFrame([("https://shop.vn/c/d/e", page), ("https://leer.vn/", None)], "url string, html string")
    found = {r.link: r.has_parent for r in links.category_links(rows).collect()}
    base = "https://shop.vn"
    assert found == {f"{base}/bep-tu": False, f"{base}/bep-tu-bosch.html": True, f"{base}/c/may-giat/lg": False, f"{base}/may-giatlg": False, f"{base}/x//bep-tu-y": True}
    assert {r.link for r in links.category_pages(rows).collect()} == {f"{base}/bep-tu", f"{base}/c/may-giat/lg", f"{base}/may-giatlg"}
    assert [r.position for r in links.anchors(rows).orderBy("position").collect()] == list(range(12))
