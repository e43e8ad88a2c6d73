"""Extraction from captured pages: each page is parsed once in a task, and all that later steps need comes out in one row.

Parsing yields texts and raw price candidates in the order in which they would be tried; reading, checking and choosing
prices is left to native expressions.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import matching, money, urls
from marketloom.functions.base import let

# Elements and selectors in the order in which they are tried, and words that mark junk.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = (".product-info-main", ".product-detail", ".product-summary", ".summary", "article.product", "main", "#main", "#content")
PRICE_SELECTORS = (
    ".price-info__sale", "[class*='product-price']", "[class*='product_price']", "[class*='new_price']", "[class*='new-price']", "[class*='price_new']", "[class*='price-new']",
    "[class*='sale_price']", "[class*='sale-price']", "[class*='price_sale']", "[class*='price-sale']", "[class*='special_price']", "[class*='special-price']",
    "[class*='current_price']", "[class*='current-price']", "ins .woocommerce-Price-amount", "ins .amount", "ins", ".price-new", ".price-amount", ".current-price",
    ".special-price", ".sale-price", ".woocommerce-Price-amount", ".amount", ".price", ".product-price", ".gia-ban", ".giaban", ".gia-khuyen-mai", ".gia-km", ".price-current",
    ".pro-price", ".product-price-new", ".price-box", ".gia_ban", ".gia_khuyen_mai", ".gia_km", ".gia",
)
OLD_PRICE = ("old-price", "compare-at-price", "original-price", "price-old", "price-compare")
JUNK = (
    "related", "upsell", "cross-sell", "recommend", "suggested", "product-slider", "similar", "may-like", "carousel", "slider", "aside", "sidebar", "widget", "review", "news",
    "blog", "post", "gift-product", "promo-product", "offer-product",
)
DISCOUNT = ("tiet kiem", "save", "saving", "discount", "giam gia", "tra gop", "installment", "combo")
META_PRICES = ("product:price:amount", "product:price", "og:price:amount", "og:price")
CURRENCY = ("đ", "₫", "vnd", "vnđ", "đồng")


class Node:
    """An element of a page."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> str:
        return self.attrs.get("class", "")

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def ancestors(self) -> list[Node]:
        found, node = [], self
        while node is not None:
            found.append(node)
            node = node.parent
        return found

    def fits(self, selector: str) -> bool:
        """One simple selector: tag, .class, #id, tag.class, [attr='x'], [class*='x']; or two with a blank between."""
        if " " in selector:
            outer, inner = selector.split(" ", 1)
            return self.fits(inner) and any(a.fits(outer) for a in self.ancestors()[1:])
        if selector[0] == "[":
            name, value = selector[1:-1].split("=", 1)
            value = value.strip("'\"")
            return value in self.attrs.get(name[:-1], "") if name[-1] == "*" else self.attrs.get(name) == value
        if "#" in selector:
            return self.attrs.get("id") == selector.split("#")[1]
        tag, _, name = selector.partition(".")
        return (not tag or self.tag == tag) and (not name or name in self.classes.split())


@lru_cache(maxsize=1 << 16)
def price_selectors(tag: str, classes: str) -> tuple[int, ...]:
    """The places in ``PRICE_SELECTORS`` of those that fit an element, of two-part ones the inner part: one look-up for each element."""
    node = Node(tag, {"class": classes}, None)
    return tuple(i for i, s in enumerate(PRICE_SELECTORS) if node.fits(s.rpartition(" ")[2]))


def _priced(marked: list[Node]) -> list[tuple[int, Node]]:
    """Selectors and the elements that they fit: in the order of the selectors, of one in the order of the document."""
    found: list[list[Node]] = [[] for _ in PRICE_SELECTORS]
    for n in marked:
        for i in price_selectors(n.tag, n.classes):
            outer = PRICE_SELECTORS[i].rpartition(" ")[0]
            if not outer or any(a.fits(outer) for a in n.ancestors()[1:]):
                found[i].append(n)
    return [(i, n) for i, those in enumerate(found) for n in those]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.here = self.root

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        for node in self.here.ancestors():
            if node.tag == tag:
                self.here = node.parent
                break

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def dom_distance(a: Node, b: Node) -> int:
    """Steps from one element to the other over their lowest common ancestor; 999999 if they have none."""
    depth = {id(n): k for k, n in enumerate(b.ancestors())}
    return next((k + depth[id(n)] for k, n in enumerate(a.ancestors()) if id(n) in depth), 999999)


def _fold(value: str) -> str:
    """Accents off, d with stroke to d, lower case; no combining mark comes before U+0300."""
    if value.isascii():
        return value.lower()
    return "".join(c for c in unicodedata.normalize("NFD", value) if c < "\u0300" or not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "d").lower()


@lru_cache(maxsize=1 << 16)
def _junk_marks(tag: str, classes: str, element_id: str) -> bool:
    """Whether an element is by its own marks a struck-through, old, related or promotional part."""
    marks = f"{classes}\n{element_id}".lower()
    return tag in ("del", "s") or any(w in classes.lower() for w in OLD_PRICE) or any(w in marks for w in JUNK)


def _says_discount(node: Node) -> bool:
    said = _fold(f"{node.classes} {node.attrs.get('id', '')} {node.text()[:100]}")
    return any(w in said for w in DISCOUNT)


def is_junk(node: Node, discounts: dict[int, bool] | None = None) -> bool:
    """Inside a struck-through, old, related or promotional part; or near words of a discount.

    ``discounts``: of the page's elements looked at before, whether they have such words; it is added to.
    """
    ups = node.ancestors()
    if any(_junk_marks(up.tag, up.classes, up.attrs.get("id", "")) for up in ups[:-1]):
        return True
    discounts = {} if discounts is None else discounts
    for up in ups[:4]:
        if up.parent is None or up.tag == "body":
            break
        if id(up) not in discounts:
            discounts[id(up)] = _says_discount(up)
        if discounts[id(up)]:
            return True
    return False


def _scripts(root: Node) -> Iterator[object]:
    for node in root.walk():
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                yield json.loads(node.text())
            except ValueError:
                continue


def _objects(value: object, names: tuple = ()) -> Iterator[tuple[dict, tuple]]:
    """Every JSON object, outer first, with the names of the products around it."""
    if isinstance(value, list):
        for item in value:
            yield from _objects(item, names)
    elif isinstance(value, dict):
        if value.get("@type") == "Product" and value.get("name"):
            names = (*names, str(value["name"]))
        yield value, names
        for item in value.values():
            if isinstance(item, (dict, list)):
                yield from _objects(item, names)


def titles(root: Node) -> str:
    """Title, headings, meta titles and product names of a page, joined by blanks."""
    metas = {n.attrs.get("name") or n.attrs.get("property"): n.attrs.get("content", "") for n in reversed(list(root.walk())) if n.tag == "meta"}
    nodes = list(root.walk())
    first = next((n.text() for n in nodes if n.tag == "title"), "")
    heads = [" ".join(n.text() for n in nodes if n.tag == tag) for tag in ("h1", "h2")]
    names = [str(o["name"]) for data in _scripts(root) for o, _ in _objects(data) if o.get("@type") == "Product" and o.get("name")]
    return " ".join([first, *heads, *(metas.get(k, "") for k in ("title", "og:title", "twitter:title")), " ".join(names)])


def price_candidates(root: Node, learned: str | None = None, json_prices: bool = True) -> list[dict]:
    """Raw prices in the order in which they are tried: stage, selector, text, whether it was a number, product names around it."""
    out: list[dict] = []

    def add(stage: int, selector: str, raw: object, names: tuple = ()) -> None:
        if raw is not None and raw != "":
            out.append({"stage": stage, "selector": selector, "raw": str(raw), "numeric": isinstance(raw, (int, float)), "names": list(names)})

    nodes = list(root.walk())
    main = next((n for s in CONTAINERS for n in nodes if n.fits(s)), None) or next((n for n in nodes if n.tag == "body"), root)
    inner = [n for n in main.walk() if n is not main]
    value = lambda n: n.attrs.get("content") or n.attrs.get("value") or n.text()
    junk: dict[int, bool] = {}
    discounts: dict[int, bool] = {}

    def bad(n: Node) -> bool:
        if id(n) not in junk:
            junk[id(n)] = is_junk(n, discounts)
        return junk[id(n)]

    marked = [n for n in inner if n.classes or n.tag == "ins"]  # all that the listed selectors can fit
    for n in inner if learned else ():
        if n.fits(learned) and not bad(n):
            add(1, learned, value(n))
    for i, n in _priced(marked):
        if not bad(n):
            add(2, PRICE_SELECTORS[i], value(n))
    if json_prices:
        for data in _scripts(root):
            for o, names in _objects(data):
                offer = o.get("@type") in ("Offer", "AggregateOffer", "Product") or any(k in o for k in ("price", "lowPrice", "highPrice"))
                if offer and (not o.get("priceCurrency") or "vnd" in str(o["priceCurrency"]).lower()):
                    for k in ("price", "lowPrice", "highPrice"):
                        add(3, "", o.get(k), names)
    for n in inner:
        if n.fits("[itemprop='price']") and not bad(n):
            add(4, "", value(n))
    metas = [n for n in nodes if n.tag == "meta"]
    for name in META_PRICES:
        add(5, "", next((n.attrs.get("content") for n in metas if n.attrs.get("property") == name), None))
    for n in metas:
        name = (n.attrs.get("name") or n.attrs.get("property") or "").lower()
        if "price" in name or "gia" in name:
            add(6, "", n.attrs.get("content"))
    for n in inner:
        if n.children and all(isinstance(c, str) for c in n.children):
            said = "".join(n.children)
            if any(c in said for c in CURRENCY) and not bad(n):
                add(7, "", said)
    return out


_CANDIDATE = pa.struct([("stage", pa.int32()), ("selector", pa.string()), ("raw", pa.string()), ("numeric", pa.bool_()), ("names", pa.list_(pa.string()))])
PAGE_SCHEMA = "url string, titles string, candidates array<struct<stage:int,selector:string,raw:string,numeric:boolean,names:array<string>>>"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, heads = [], []
        for url, html, learned, settled in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "learned", "settled"))):
            root = parse(html or "")
            heads.append(titles(root))
            found.append([] if settled else price_candidates(root, learned, "kocher.vn" not in (urlsplit(url or "").hostname or "")))
        yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(heads, pa.string()), pa.array(found, pa.list_(_CANDIDATE))], ["url", "titles", "candidates"])


def extract(pages: DataFrame, learned: DataFrame | None = None, settled: DataFrame | None = None) -> DataFrame:
    """(url, titles, candidates) for each row of ``pages`` (url, html); ``learned``: domain, selector.

    ``settled`` (url): pages whose price is known; they are read for their titles and not searched for candidates.
    """
    base = pages.select("url", "html")
    if learned is not None:
        base = base.withColumn("domain", urls.host(F.col("url"))).join(learned.select("domain", F.col("selector").alias("learned")), "domain", "left").drop("domain")
    else:
        base = base.withColumn("learned", F.lit(None).cast("string"))
    if settled is not None:
        base = base.join(settled.select("url", F.lit(True).alias("settled")).distinct(), "url", "left")
    else:
        base = base.withColumn("settled", F.lit(False))
    return base.select("url", "html", "learned", "settled").mapInArrow(_pages, PAGE_SCHEMA)


def verify(titles_: Column, url: Column, model: Column, brand: Column) -> Column:
    """NULL for a page about the model; else the reason why it is not."""
    def reason(t: Column, u: Column, nm: Column, b: Column, nt: dict[str, Column]) -> Column:
        missing = F.when((b != "") & nt["t"].contains(b), "Only brand matched, model missing").otherwise("Model not found")
        checked = F.when(~(t["matched"] | u["matched"]), missing).when(t["bare_suffix"] | u["bare_suffix"], "Conflicting suffix found (extended model)").when(t["prefix"] | u["prefix"], "Conflicting prefix found")
        return F.when(nm == "", "Empty model").otherwise(checked)

    # The suffix is judged without the brand here.
    return matching.judged_each({"t": titles_, "u": url}, model, brand, reason)


def choose_price(candidates: Column, model: Column, reference: Column) -> Column:
    """The first plausible candidate: its price and the selector that found it; NULL if none is. Later ones are not read."""

    def read(c: Column) -> Column:
        price = F.when(c["numeric"], money.parse_price_number(c["raw"].try_cast("double"))).otherwise(money.parse_price_text(c["raw"]))
        return F.struct(price.alias("price"), c["selector"].alias("selector"), c["names"].alias("names"))

    good = lambda c: money.is_plausible(c["price"], reference, model) & ~F.exists(c["names"], lambda n: ~matching.model_match(n, model))
    kind = "struct<price:bigint,selector:string,names:array<string>>"
    first = lambda found, c: F.when(found.isNotNull(), found).otherwise(let(read(c), lambda r: F.when(good(r), r.cast(kind))))
    return F.aggregate(candidates, F.lit(None).cast(kind), first)


def page_prices(products: DataFrame, extracted: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """``products`` (url, model, brand, reference) with reject_reason, price and the selector that found it.

    ``cached`` (url, price; one row a URL, see sources.cache): a page that passes verification takes its known price, and its candidates are not read.
    """
    joined = products.join(extracted, "url", "left").withColumn("reject_reason", F.when(F.col("titles").isNull(), "Page not found").otherwise(verify(F.col("titles"), F.col("url"), F.col("model"), F.col("brand"))))
    if cached is not None:
        joined = joined.join(cached.select("url", F.col("price").cast("bigint").alias("known")), "url", "left")
    else:
        joined = joined.withColumn("known", F.lit(None).cast("bigint"))
    passed = F.col("reject_reason").isNull()
    chosen = joined.withColumn("chosen", F.when(passed & F.col("known").isNull(), choose_price(F.col("candidates"), F.col("model"), F.col("reference"))))
    price = F.coalesce(F.when(passed, F.col("known")), F.col("chosen.price"))
    return chosen.withColumns({"price": price, "selector": F.col("chosen.selector")}).drop("chosen", "known", "titles", "candidates")
