"""Offers of listing pages: each price on a page with the title, and the link, that stand nearest to it.

A page is read once, into rows of its elements with interval labels: an element's number in document order (entry), the
last number inside it (exit), and its depth. All else is joins over these labels. From a price one climbs its
ancestors; the nearest title of an ancestor's own subtree is worked out once for the ancestor, not for each price, and
the first ancestor that has one is the lowest common ancestor of price and title. On the way titles and links are
numbers (distance, then place), so aggregates need no sorts; rows are dealt over tasks by the number of elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import money, urls
from marketloom.functions.base import any_contained
from marketloom.operators.html import Node, parse
from marketloom.session import dealt, stored

#: Ancestors climbed from a price, elements from a title within which its link is looked for, lengths of a title.
CLIMB, LINK_STEPS, SHORTEST, LONGEST = 5, 3, 8, 149
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "a")
# What a title never contains.
TRASH = (
    "chính sách", "hướng dẫn", "tin tức", "liên hệ", "bài viết", "giỏ hàng", "tài khoản", "showroom", "tuyển dụng", "địa chỉ", "hotline", "góp ý", "bảo hành", "trả góp",
    "thương hiệu", "nổi bật", "cổ điển", "xem thêm", "danh mục", "giới thiệu", "đăng ký", "đăng nhập", "tin công nghệ", "hệ thống", "sơ đồ", "khuyến mãi", "khuyen mai",
    "ưu đãi", "uu dai", "nhập mã", "nhap ma", "mã giảm giá", "ma giam gia", "quà tặng", "qua tang", "thông số", "thong so", "kỹ thuật", "ky thuat", "mô tả", "mo ta",
    "chi tiết", "chi tiet", "đặc điểm", "dac diem",
)
#: Elements whose text counts for themselves alone, classes that mark a struck price, and text kept of an element at most.
UNSEEN, STRUCK, KEPT_CHARS = ("script", "style", "template"), (".line", ".old", ".del", "del", "s"), 2000
#: Elements in a file: a task reads several small files, never more than these few.
ROWS_A_FILE = 50_000
_SETUP = re.compile(r"productSaleSetup\s*\(\s*'[^']*'\s*,\s*'[^']*'\s*,\s*'[^']*'\s*,\s*'[^']*'\s*,\s*'\s*([0-9]+)\s*'")

NODES = (
    "url string, entry int, exit int, depth int, tag string, id string, classes string, style string, href string, text string, price_text string, scripted boolean, path array<int>, tags array<string>, marks array<string>, own_href string"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _struck(node: Node) -> bool:
    return "line-through" in node.attrs.get("style", "") or any(node.fits(s) for s in STRUCK)


def _short(parts: list[str]) -> str | None:
    """The joined text, or None where it is longer than any title or price."""
    return None if sum(map(len, parts)) > KEPT_CHARS else "".join(parts)


def _around(node: Node) -> tuple[list[str], list[str]]:
    """Tags, and ids with classes, of the ancestors that are climbed, the nearest first."""
    tags, marks = [], []
    while (node := node.parent) is not None and len(tags) < CLIMB:
        tags.append(node.tag)
        marks.append(f"{node.attrs.get('id', '')}\n{node.classes}")
    return tags, marks


def _own_href(node: Node | None) -> str | None:
    """The link of the nearest ``a`` from an element on up, within ``LINK_STEPS`` elements."""
    for _ in range(LINK_STEPS):
        if node is None:
            break
        if node.tag == "a":
            return node.attrs.get("href", "")
        node = node.parent
    return None


def labelled(root: Node) -> list[tuple]:
    """Rows of ``NODES`` without the url, in document order: a walk with a stack, texts from the leaves up."""
    rows, stack, path = [], [(root, False)], []
    texts: dict[int, tuple[str | None, str | None]] = {}  # of finished elements: all text, and text that is not struck through
    entries: dict[int, int] = {}
    while stack:
        node, done = stack.pop()
        if not done:
            entries[id(node)] = len(rows)
            rows.append(None)
            path.append(len(rows) - 1)
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children) if isinstance(c, Node)]
            continue
        path.pop()
        whole, clear = [], []
        for c in node.children:
            if isinstance(c, str):
                whole.append(c)
                clear.append(c)
            elif c.tag not in UNSEEN:
                own, own_clear = texts[id(c)]
                whole.append(own if own is not None else " " * (KEPT_CHARS + 1))
                if not _struck(c):
                    clear.append(own_clear if own_clear is not None else " " * (KEPT_CHARS + 1))
        text, price = texts[id(node)] = _short(whole), _short(clear)
        setup = _SETUP.search(text or "") if node.tag == "script" else None
        if node.tag in UNSEEN:
            text, price = None, f"{int(setup[1]):,} ₫".replace(",", ".") if setup and int(setup[1]) else None
        squeeze = lambda t: " ".join(t.split()) if t is not None else None
        text, price = squeeze(text), squeeze(price)
        text = text if text is not None and len(text) <= LONGEST else None
        price = price if price is not None and len(price) <= LONGEST else None
        a = node.attrs
        at = entries[id(node)]
        tags, marks = _around(node) if price and any(map(str.isdigit, price)) else (None, None)
        own_href = _own_href(node) if node.tag in HEADINGS else None
        rows[at] = (at, len(rows) - 1, len(path), node.tag, a.get("id", ""), node.classes, a.get("style", ""), a.get("href"), text, price, setup is not None, list(path), tags, marks, own_href)
    return rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = zip(*(x.split(" ") for x in NODES.split(", ")))
    for batch in batches:
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            rows = [(url, *r) for r in labelled(parse(html or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows), types)], list(names))


def elements(pages: DataFrame) -> DataFrame:
    """The ``NODES`` of each page (url, html); the document itself is element 0, at depth 0. Several joins read them, so they are written once.

    ``path``: entries of an element's ancestors, the document first. A text longer than a title or price may be is null.
    ``tags``, ``marks``: of ancestors that are climbed, where there may be a price; ``own_href``: a heading's own link.
    ``priced``, ``price_shown``, ``headed``: whether the text is a price, the unstruck text is one, and the text may be a title.
    """
    shaped = lambda c: F.when(F.col(c).rlike("[0-9]"), money.is_price_shaped(F.col(c)))
    judged = {
        "priced": F.coalesce(shaped("text"), F.lit(False)), "price_shown": F.col("scripted") | (F.coalesce(shaped("price_text"), F.lit(False)) & ~F.col("tag").isin(*UNSEEN)),
        "headed": F.when(F.col("tag").isin(*HEADINGS), is_title(F.col("text"))).otherwise(False),
    }
    return stored(pages.select("url", "html").mapInArrow(_read, NODES).withColumns(judged), "elements", ROWS_A_FILE)


def is_original(tag: Column, classes: Column, style: Column) -> Column:
    """Whether a price is the one from before: struck through, or of a class that says so."""
    return any_contained(classes, ("line", "old", "del")) | tag.isin("del", "s") | style.contains("line-through")


def is_title(text: Column) -> Column:
    """Whether a heading may name a product: 8 to 149 characters, no price, none of the trash words."""
    return F.coalesce(F.length(text).between(SHORTEST, LONGEST) & ~money.is_price_shaped(text) & ~any_contained(F.lower(text), TRASH), F.lit(False))


def prices(nodes: DataFrame, rows: int) -> DataFrame:
    """The elements that show a price themselves: no child shows one, unless all that do show the price from before."""
    kept = ~is_original(F.col("tag"), F.col("classes"), F.col("style"))
    children = nodes.where(F.col("priced") & kept & (F.col("depth") > 0)).select("url", F.element_at("path", -1).alias("entry"))
    above = dealt(children, rows, "url", "entry").groupBy("url", "entry").agg(F.count("*").alias("n_above"))
    shown = nodes.where((F.col("depth") > 0) & F.col("price_shown"))
    return dealt(shown, rows, "url", "entry").join(above, ["url", "entry"], "left").where("n_above IS NULL").drop("n_above")


def _place(depth: Column, named: Column, entry: Column) -> Column:
    """One number that orders titles or links by depth (later by distance), then by name, then by place in the document."""
    return F.shiftleft(depth.cast("bigint"), 32) + F.shiftleft(named.cast("bigint"), 31) + entry


def _entry(place: Column) -> Column:
    return place.bitwiseAND(F.lit(2**31 - 1)).cast("int")


def nearest(nodes: DataFrame) -> DataFrame:
    """(url, position, title, price_text, href, is_original) of each price with a title.

    One climbs up to ``CLIMB`` ancestors, and no further than one that is excluded or lays out the page. Of an ancestor's
    titles the least deep counts, then one whose class says title or name, then the first; one that holds the price is
    nearer than any beside it. Its link is the nearest ``a`` from it on up, or else the link nearest to the price.
    """
    rows = nodes.count()
    laid = lambda m: urls.is_excluded(m["marks"], F.lit("")) | urls.is_layout(m["marks"], F.lit(""), m["tags"])
    first_stop = F.array_position(F.transform(F.arrays_zip("tags", "marks"), lambda m, i: laid(m) | (F.col("depth") == i + 1)), F.lit(True))
    up = F.concat(F.array("entry"), F.slice(F.reverse("path"), 1, CLIMB))
    shown = prices(nodes, rows).select(
        "url", F.col("entry").alias("price"), "depth", "price_text", "scripted", (~F.col("scripted") & is_original(F.col("tag"), F.col("classes"), F.col("style"))).alias("is_original"),
        up.alias("up"), first_stop.cast("int").alias("first_stop"),
    )
    # a step: the price itself (0), then its ancestors before the first that stops the climb; none where the parent does
    n_open = F.when(F.col("first_stop") == 0, F.size("up")).when(F.col("first_stop") == 1, 0).otherwise(F.col("first_stop"))
    steps = shown.withColumn("n", n_open).select("url", "price", "depth", "n", F.posexplode(F.slice("up", 1, F.col("n"))).alias("step", "entry"))

    is_link = (F.col("tag") == "a") & (F.length("href") > 2) & ~F.col("href").rlike("^(#|javascript:)")
    links = nodes.where(is_link)
    named = F.when(F.lower("classes").rlike("title|name"), 0).otherwise(1)
    t, l = F.when(F.col("headed"), _place(F.col("depth"), named, F.col("entry"))), F.when(is_link, _place(F.col("depth"), F.lit(0), F.col("entry")))
    marked = nodes.where(F.col("headed") | is_link).select("url", F.col("entry").alias("e"), t.alias("t"), l.alias("l"), F.explode(F.concat("path", F.array("entry"))).alias("entry"))
    inside, own = (lambda c: F.min(F.when(F.col("entry") != F.col("e"), F.col(c)))), (lambda c: F.min(F.when(F.col("entry") == F.col("e"), F.col(c))))
    spots = dealt(marked, rows, "url", "entry").groupBy("url", "entry").agg(inside("t").alias("t"), inside("l").alias("l"), own("t").alias("own_t"), own("l").alias("own_l"))
    met = dealt(steps, rows, "url", "entry").join(spots, ["url", "entry"])

    # what is inside an element is met in its own frame, the element itself in the next; what is inside the price itself,
    # or is it, and what stands beside it in its parent, is of one frame: distance decides
    frame, after = F.greatest("step", F.lit(1)), F.when((F.col("step") == 0) | (F.col("step") + 1 < F.col("n")), F.col("step") + 1)
    beside = lambda c: F.col(c) + F.shiftleft((2 * F.col("step") - F.col("depth")).cast("bigint"), 32)
    holding = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)) + F.shiftleft(F.col("step").cast("bigint"), 32)
    framed = lambda f, place: F.shiftleft(f.cast("bigint"), 60) + place
    title = F.least(framed(frame, beside("t")), framed(after, holding("own_t")))
    link_by = lambda f: F.min(F.least(F.when(frame <= f, beside("l")), F.when(after <= f, holding("own_l"))))
    seen = dealt(met.select("url", "price", "depth", "n", "step", "t", "l", "own_t", "own_l"), rows, "url", "price")
    least = seen.groupBy("url", "price").agg(F.min(title).alias("title"), F.array(*[link_by(f) for f in range(1, CLIMB + 1)]).alias("links")).where("title IS NOT NULL")
    link = F.element_at("links", F.shiftright("title", 60).cast("int"))
    found = least.select("url", "price", _entry(F.col("title")).alias("e"), _entry(link).alias("link"))

    # the link of the title itself, or of the two elements around it, before the nearest one
    priced = found.join(shown.select("url", "price", "price_text", "scripted", "is_original"), ["url", "price"])
    headed = nodes.where("headed").select("url", F.col("entry").alias("e"), F.col("text").alias("title"), "own_href")
    offers = dealt(priced, rows, "url", "e").join(dealt(headed, rows, "url", "e"), ["url", "e"])
    offers = dealt(offers, rows, "url", "link").join(dealt(links.select("url", F.col("entry").alias("link"), "href"), rows, "url", "link"), ["url", "link"], "left")
    href = F.coalesce(F.nullif("own_href", F.lit("")), "href")
    position = F.struct((~F.col("scripted")).alias("shown"), F.col("price").alias("entry"))
    return offers.select("url", position.alias("position"), "title", "price_text", href.alias("href"), "is_original")


def offers(pages: DataFrame) -> DataFrame:
    """(url, title, link, price_text, price, is_original): one offer for each link, or title without one, of a page (url, html).

    A price of now counts before one from before, then the lowest, then the first; prices of scripts come first.
    """
    nodes = elements(pages)
    found = nearest(nodes).withColumn("link", urls.absolute(F.col("url"), F.col("href"))).withColumn("key", F.coalesce("link", "title"))
    priced = found.withColumn("price", F.coalesce(money.parse_price_text(F.col("price_text")), F.lit(0)))
    rank = F.struct("is_original", F.when(F.col("is_original"), F.lit(0)).otherwise(F.when(F.col("price") > 0, F.col("price")).otherwise(F.lit(2**62))), "position")
    values = F.struct("title", "link", "price_text", "price", "is_original")
    return dealt(priced, nodes.count(), "url", "key").groupBy("url", "key").agg(F.min_by(values, rank).alias("v")).select("url", "v.*")
