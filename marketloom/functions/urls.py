"""URL functions and relevance scoring, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.base import any_contained, lets
from marketloom.functions.matching import judged, suffix_conflict
from marketloom.functions.text import normalize_model

# Hosts, paths and words that tell what a URL is.
BLOCKED_HOSTS = ("google.com", "google.com.vn", "duckduckgo.com", "bing.com", "coccoc.com", "bepngocbao.vn", "websosanh.vn")
BLOCKED_PATHS = (
    "/search", "/collections", "/collection", "/category", "/categories", "/danh-muc", "/tag/", "/tags/", "/blogs/", "/blog/", "/tin-tuc", "/news/", "?q=", "&q=", "/gioi-thieu",
    "/about", "/lien-he", "/contact", "/huong-dan", "/huong_dan", "/thu-vien", "/thuvien", "/review", "/danh-gia", "/danh_gia", "/kinh-nghiem", "/kinh_nghiem", "/bai-viet",
    "/bai_viet", "/article", "/cau-hoi", "/cau_hoi", "/chinh-sach", "/tuyen-dung", "/tuyen_dung", "/gio-hang", "/cart", "/checkout", "/payment", "/agency", "/dai-ly",
    "/he-thong-cua-hang", "/store-locator", "/tin-khuyen-mai", "/khuyen-mai", "/khuyen_mai", "/uu-dai", "/dieu-khoan", "/terms-of-use", "/privacy-policy", "/policy/", "/chinh-sach-",
)
PRODUCT_PATHS = ("/product/", "/products/", "/p/", "/sp/", "/san-pham/", "/detail/", "/item/")
SHOP_PATHS = (*PRODUCT_PATHS, "/shop/", "/store/")
SLUG = r"/(product|products|p|sp|san-pham|ct|chi-tiet|detail|item|shop|store)/"
NON_COMMERCIAL = ("google", "bing", "duckduckgo", "coccoc", "wordpress", "blogspot", "medium", "wikipedia", "facebook", "youtube", "pinterest")
TRUSTED = ("dienmayxanh.com", "nguyenkim.com", "mediamart.vn", "hc.com.vn", "dienmaycholon.vn", "cellphones.com.vn", "fptshop.com.vn")
PENALISED = ("search", "tim-kiem", "collection", "collections", "category", "danh-muc", "tag", "tags", "news", "tin-tuc", "blog", "article", "gio-hang", "cart", "checkout")
HOME_PATHS = ("", "/", "/index.html", "/index.php", "/index.htm")
CATEGORY_WORDS = (
    "bếp", "bep", "gas", "ga", "hút mùi", "hut mui", "rửa chén", "rua chen", "rửa bát", "rua bat", "lò nướng", "lo nuong", "vi sóng", "vi song", "chậu", "chau", "vòi", "voi",
    "tủ lạnh", "tu lanh", "máy giặt", "may giat", "máy sấy", "may say", "nồi", "noi", "chảo", "chao", "siêu tốc", "sieu toc", "máy xay", "may xay", "máy ép", "may ep", "bàn ủi",
    "ban ui", "bàn là", "ban la", "hút bụi", "hut bui", "quạt", "quat", "gia dụng", "gia dung", "tủ đông", "tu dong", "lò vi sóng", "lo vi song", "chén bát", "chen bat",
    "chậu rửa", "chau rua", "vòi rửa", "voi rua", "âm tủ", "am tu",
)
CATEGORY_EXCLUSIONS = (
    "/tin-tuc", "/lien-he", "/gioi-thieu", "/cart", "/checkout", "/login", "/register", "/account", "/search", "/tin-cong-nghe", "/chinh-sach", "/huong-dan", "/tuyen-dung",
    "/show-room", "/bao-hanh", "/tra-gop", "/he-thong-dai-ly", "/hinh-thuc-mua-hang", "/hinh-thuc-thanh-toan", "/dieu-khoan-su-dung", "/chinh-sach-bao-mat", "/chinh-sach-doi-tra",
    "/chinh-sach-giao-nhan", "/chinh-sach-bao-mat-thong-tin", "/taikhoan",
)
EXCLUDED_PARTS = (
    "menu", "sidebar", "footer", "header", "nav", "aside", "widget", "filter", "banner", "slider", "carousel", "breadcrumb", "search", "cart", "checkout", "login", "register",
    "auth", "social", "share", "comment", "review", "rating", "newsletter", "subscribe", "pagination",
)
LAYOUT_TAGS = ("body", "html", "main", "section", "article", "aside", "header", "footer")
LAYOUT_PARTS = ("grid", "row", "list", "layout", "content", "body", "main", "wrapper")


def url_part(url: Column, part: str) -> Column:
    """HOST, PATH and so on; NULL for what is no URL."""
    return F.try_parse_url(url, F.lit(part))


def host(url: Column) -> Column:
    return F.lower(url_part(url, "HOST"))


def path(url: Column) -> Column:
    return F.coalesce(url_part(url, "PATH"), F.lit(""))


def is_homepage(url: Column) -> Column:
    """Whether the path is one of the five forms of a home page; text without a scheme is none."""
    return F.coalesce(url_part(url, "HOST").isNotNull() & F.lower(path(url)).isin(*HOME_PATHS), F.lit(False))


def last_segment(url: Column) -> Column:
    """The last non-empty part of the path; NULL if there is none."""
    return F.get(F.reverse(F.filter(F.split(path(url), "/"), lambda s: s != "")), F.lit(0))


def decode_bing(url: Column) -> Column:
    """The target of a Bing redirect; any other URL, or one that doesn't decode to http, as it is."""
    code = F.regexp_replace(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("u"))), "^a1?", "")
    padded = F.translate(F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("=")), "-_", "+/")
    target = F.try_to_binary(padded, F.lit("base64")).cast("string")
    is_redirect = host(url).contains("bing.com") & (url_part(url, "PATH") == "/ck/a")
    return F.when(is_redirect & target.startswith("http"), target).otherwise(url)


def normalize_href(href: Column) -> Column:
    """The target of a link on a search page; NULL for links that lead nowhere outside."""
    asked = F.try_url_decode(F.try_parse_url(F.concat(F.lit("https://www.google.com"), href), F.lit("QUERY"), F.lit("q")))
    return F.when(href.startswith("/url?"), asked).when(href.rlike("^https?://"), F.when(href.contains("bing.com/ck/a"), decode_bing(href)).otherwise(href))


def without_dots(url_path: Column) -> Column:
    """A path from the root without ``.`` and ``..``: a fold over its segments, ``..`` taking the last one back."""
    parts = F.split(url_path, "/")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.array_append(kept, s))
    folded = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)
    return F.when(url_path.contains("/."), F.array_join(ended, "/")).otherwise(url_path)


def absolute(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``, as RFC 3986 resolves references; one that has a scheme, or a site, stays as it is."""
    scheme, own = url_part(base, "PROTOCOL"), F.when(path(base) == "", "/").otherwise(path(base))
    site = F.concat(scheme, F.lit("://"), url_part(base, "AUTHORITY"))
    head, tail = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    merged = F.when(head.startswith("/"), head).otherwise(F.concat(F.regexp_replace(own, "[^/]*$", ""), head))
    same = F.concat(F.when(tail.startswith("?"), F.regexp_extract(base, "^[^?#]*", 0)).otherwise(F.regexp_extract(base, "^[^#]*", 0)), tail)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(head == "", same)
        .otherwise(F.concat(site, without_dots(merged), tail))
    )


def matches_category(text: Column, url_path: Column) -> Column:
    """Whether a product category is named in the text, or in the path with hyphens for blanks."""
    return any_contained(F.lower(F.coalesce(text, F.lit(""))), CATEGORY_WORDS) | any_contained(F.lower(F.coalesce(url_path, F.lit(""))), [w.replace(" ", "-") for w in CATEGORY_WORDS])


def is_excluded(element_id: Column, classes: Column) -> Column:
    return any_contained(F.lower(F.concat_ws("\n", element_id, classes)), EXCLUDED_PARTS)


def is_layout(element_id: Column, classes: Column, tag: Column) -> Column:
    both = F.lower(F.concat_ws("\n", element_id, classes))
    return F.lower(tag).isin(*LAYOUT_TAGS) | (~any_contained(both, ("item", "col-")) & any_contained(both, LAYOUT_PARTS))


def is_detail_url(url: Column, model: Column | None = None, brand: Column | None = None) -> Column:
    """Whether a URL looks like a product's own page, and of this model if one is given."""
    low = F.lower(url)
    allowed = low.startswith("http") & ~any_contained(low, BLOCKED_HOSTS) & ~any_contained(low, BLOCKED_PATHS)
    page = any_contained(low, PRODUCT_PATHS) | low.contains(".htm") | last_segment(url).contains("-")
    general = last_segment(url).isNotNull() & page
    if model is None:
        return F.coalesce(allowed & general, F.lit(False))

    def of_model(nu: Column, nm: Column, nb: Column) -> Column:
        digits = F.regexp_replace(nm, "[^0-9]", "")
        near = ((F.length(digits) >= 3) & nu.contains(F.substring(digits, 1, 4))) | any_contained(low, SHOP_PATHS)
        parts = F.filter(F.regexp_extract_all(model, F.lit("[a-zA-Z]+|[0-9]+"), F.lit(0)), lambda t: F.length(t) >= 3)
        named = ((nm != "") & nu.contains(nm)) | ((F.length(digits) >= 4) & nu.contains(digits)) | ((nb != "") & nu.contains(nb) & near)
        return named | (F.exists(parts, lambda t: nu.contains(F.upper(t))) & general)

    with_model = lets({"nu": normalize_model(url), "nm": normalize_model(model), "nb": F.lit("") if brand is None else normalize_model(brand)}, of_model)
    given = F.coalesce(model, F.lit("")) != ""
    return F.coalesce(allowed & F.when(given, ~suffix_conflict(url, model, brand) & with_model).otherwise(general), F.lit(False))


def relevance_score(url: Column, model: Column, brand: Column) -> Column:
    """0 to 300: how likely a URL is the product's page."""
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    low = F.lower(url)

    def total(j: Column, nu: Column, nm: Column, nb: Column) -> Column:
        site, matched = host(url), j["matched"]
        score = points(matched, 150) + points((nm != "") & nu.contains(nm), 40) + points((nb != "") & nu.contains(nb), 20)
        score = score + points(url.contains("-"), 10) + points(low.rlike(SLUG), 10) + points(low.rlike(r"\.html?(?:$|[?#])"), 10)
        score = score + points((site != "") & ~any_contained(site, NON_COMMERCIAL), 10) + points(matched & any_contained(site, TRUSTED), 100)
        score = score - points(any_contained(low, PENALISED), 50) - points(j["suffix"] | j["prefix"], 100)
        return F.greatest(F.lit(0), F.least(F.lit(300), score))

    scored = lets({"j": judged(url, model, brand), "nu": normalize_model(url), "nm": normalize_model(model), "nb": normalize_model(brand)}, total)
    return F.when(F.coalesce(model, F.lit("")) == "", 0).otherwise(scored)
