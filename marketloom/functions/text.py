"""Text, model-code and row-selection functions, as native Column expressions (NULL counts as an empty text)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.base import let, no_strings, strings

#: Colour and material words that may close a model name.
COLOUR_WORDS = ("bạc", "đen", "trắng", "xám", "đỏ", "gold", "silver", "black", "white", "grey", "gray", "new", "inox", "kính")
#: Brands looked for in titles, in the order in which they are tried.
BRANDS = ("bosch", "hafele", "tefal", "konox", "kluger", "canzy", "eurosun", "junger", "kocher", "grandx", "toshiba", "supor", "garis", "kaff")
#: Words that don't belong to a commercial name.
NAME_STOP_WORDS = (
    "máy", "rửa", "chén", "bát", "vòi", "khóa", "hút", "mùi", "bếp", "tủ", "lò", "nồi", "chảo", "bộ", "inox", "cao", "cấp", "âm", "đơn", "đôi", "điện", "từ", "gas",
)
#: Rounds after which stripping of specifications has settled on every known model name.
SPEC_ROUNDS = 5


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Precomposed letters and their bases: every single-letter NFD pair from U+00C0 to U+1EFF, and d with stroke."""
    pairs = {"đ": "d", "Đ": "d"}
    for code in range(0xC0, 0x1F00):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def normalize_text(value: Column) -> Column:
    """Accents off, d with stroke to d, trimmed, lower case."""
    source, target = _folding()
    plain = F.octet_length(value) == F.char_length(value)  # ASCII has no accents
    return F.coalesce(F.lower(F.trim(F.when(plain, value).otherwise(F.regexp_replace(F.translate(value, source, target), r"\p{M}", "")))), F.lit(""))


def _one_decimal(number: Column) -> Column:
    """A number with one decimal, or none if that is zero."""
    return F.regexp_replace(F.format_string("%.1f", number), r"\.0$", "")


def _rewritten(text: Column, pattern: str, factor: float, unit: str) -> Column:
    """Every match of ``pattern`` (group 1 a number) replaced by the number times ``factor`` and the unit."""
    between = F.split(text, pattern, -1)
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    new = F.transform(numbers, lambda n: F.concat(_one_decimal(F.replace(n, F.lit(","), F.lit(".")).cast("double") * factor), F.lit(unit)))
    whole = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(F.size(numbers) > 0, whole).otherwise(text)


def normalize_model(value: Column) -> Column:
    """Upper-case letters and digits of a model: + spelled out, millimetres and metres as centimetres, units dropped."""
    text = F.replace(normalize_text(value), F.lit("+"), F.lit(" plus "))
    rewritten = lambda t: let(_rewritten(t, r"\b(\d+(?:\.\d+)?)\s*mm\b", 0.1, "cm"), lambda u: let(_rewritten(u, r"\b(\d+(?:[.,]\d+)?)\s*m\b", 100.0, "cm"), _closed))
    # without a digit before m or cm there is no length to rewrite
    return let(text, lambda t: F.when(t.rlike(r"\d\s*c?m"), rewritten(t)).otherwise(F.upper(F.regexp_replace(t, "[^a-zA-Z0-9]", ""))))


def _closed(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(text, r"\b(\d+(?:\.\d+)?)\s*cm\b", "$1"), "[^a-zA-Z0-9]", ""))


def clean_model_specs(model: Column) -> Column:
    """A model without closing parentheses, widths in cm and colour words."""
    colours = r"(?iU)[-_\s]+(" + "|".join(COLOUR_WORDS) + r")\b"

    def once(text: Column, _: Column) -> Column:
        for pattern in (r"\s*\([^)]*\)\s*$", r"(?i)[-_\s]*\d+\s*cm\b", colours):
            text = F.trim(F.regexp_replace(text, pattern, ""))
        return text

    return F.aggregate(F.array(*[F.lit(k) for k in range(SPEC_ROUNDS)]), F.trim(F.coalesce(model, F.lit(""))), once)


def clean_title(text: Column) -> Column:
    """Bracketed parts and bars off, white space collapsed."""
    out = F.coalesce(text, F.lit(""))
    for pattern in (r"\[[^\]]+\]", r"\([^)]*\)", r"\|", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def decode_entities(text: Column) -> Column:
    """Five HTML entities, in order, so that a doubly escaped one is decoded twice."""
    out = F.coalesce(text, F.lit(""))
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def sheet_names_from_html(html: Column) -> Column:
    """Names of tabs in a workbook's page, in order, each once; the second pattern only where the first finds none."""

    def names(pattern: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))
        return F.array_distinct(F.filter(F.transform(found, lambda x: decode_entities(F.trim(x))), lambda x: x != ""))

    return let(names(r'docs-sheet-tab-caption">([^<]+)<'), lambda first: F.when(F.size(first) > 0, first).otherwise(names(r'\[0,0,"([^"]+)"\]')))


def sheet_id(url: Column) -> Column:
    """The workbook's id in a URL; '' if there is none."""
    return F.regexp_extract(url, r"/spreadsheets/d/([a-zA-Z0-9-_]+)", 1)


def parse_row_selection(spec: Column) -> Column:
    """'3, 5, 20-22' as a sorted array of rows; NULL (no filter) for an empty text or if any part is no number or range."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def rows(part: Column) -> Column:
        ends = F.transform(F.split(part, "-"), lambda e: F.trim(e).try_cast("int"))
        a, b = F.get(ends, 0), F.get(ends, F.size(ends) - 1)
        return F.when((F.size(ends) <= 2) & a.isNotNull() & b.isNotNull(), F.sequence(F.least(a, b), F.greatest(a, b)))

    found = F.transform(parts, rows)
    return F.when((F.size(parts) > 0) & ~F.exists(found, lambda r: r.isNull()), F.array_sort(F.array_distinct(F.flatten(found))))


def clean_numeric_code(value: Column) -> Column:
    """Trimmed, without one closing '.0'."""
    return F.coalesce(F.regexp_replace(F.trim(value), r"\.0$", ""), F.lit(""))


def selected_sheet_names(text: Column) -> Column:
    """Names of a comma-separated list: trimmed, each once, in order."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")), no_strings())


def is_valid_brand(brand: Column) -> Column:
    return F.trim(F.coalesce(brand, F.lit(""))) != ""


def is_valid_model(model: Column) -> Column:
    """Not blank, and more than digits."""
    return let(clean_numeric_code(model), lambda m: (m != "") & ~m.rlike(r"^\d+$"))


def is_real_model(text: Column) -> Column:
    """At least three characters, with a letter and a digit among them."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) >= 3) & t.rlike("[A-Za-z]") & t.rlike("[0-9]")


#: Shapes of model codes in upper-case titles, in the order in which they are tried.
MODEL_SHAPES = (r"\b[A-Z]{2,}[0-9]+[A-Z0-9\-]*\b", r"\b[0-9]+[A-Z]{2,}[A-Z0-9\-]*\b", r"\b[A-Z]+-[0-9]+[A-Z0-9\-]*\b", r"\b[A-Z0-9]+-[A-Z0-9]+\b", r"\bH[0-9]{2,}[A-Z0-9\-]*\b")


def model_from_title(title: Column) -> Column:
    """The longest match (the first of equals) of the first shape that matches; NULL if none does."""

    def longest(text: Column, shape: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(shape), F.lit(0))
        return F.aggregate(found, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))

    return let(F.upper(F.coalesce(title, F.lit(""))), lambda t: F.coalesce(*[longest(t, s) for s in MODEL_SHAPES]))


def commercial_name(title: Column, brand: Column) -> Column:
    """A cleaned title without the brand and the stop words."""
    text = let(clean_title(title), lambda t: F.when(F.coalesce(brand, F.lit("")) != "", F.regexp_replace(t, F.concat(F.lit("(?iu)\\Q"), brand, F.lit("\\E")), " ")).otherwise(t))
    stop = strings(NAME_STOP_WORDS)
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~F.array_contains(stop, F.lower(w))), " ")


def detect_brand(vendor: Column, title: Column) -> Column:
    """The vendor, else the first known brand in the title, capitalised; '' if there is none."""
    low = F.lower(F.coalesce(title, F.lit("")))
    found = F.get(F.filter(strings(BRANDS), lambda b: low.contains(b)), F.lit(0))
    given = F.trim(F.coalesce(vendor, F.lit("")))
    return F.when(given != "", given).otherwise(F.coalesce(F.initcap(found), F.lit("")))


def extract_model(sku: Column, barcode: Column, title: Column, brand: Column) -> Column:
    """A real SKU, else a real barcode, else a model code of the title, else its commercial name."""
    return F.when(is_real_model(sku), F.trim(sku)).when(is_real_model(barcode), F.trim(barcode)).otherwise(F.coalesce(model_from_title(title), commercial_name(title, brand)))


def mask_secret(value: Column) -> Column:
    """The first and last four characters; up to eight are hidden altogether."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v == "", "").when(F.length(v) <= 8, "****").otherwise(F.concat(F.substring(v, 1, 4), F.lit("****"), F.substring(v, -4, 4)))


def column_letter(index: Column) -> Column:
    """0-based column number as letters: A to Z, AA to ZZ, AAA to ZZZ."""
    letter = lambda n: F.char(F.lit(65) + F.pmod(n.cast("int"), F.lit(26)))
    i = index.cast("int")
    one, two = letter(i), F.concat(letter(F.floor(i / 26) - 1), letter(i))
    return F.when(i < 26, one).when(i < 702, two).otherwise(F.concat(letter(F.floor((i - 702) / 676)), letter(F.floor((i - 702) / 26)), letter(i)))


def category_keyword(sheet_name: Column) -> Column:
    """The product noun for a tab's name, by ordered tests on its normalised form."""

    def noun(name: Column) -> Column:
        has = lambda *words: name.rlike("|".join(words))
        out = F.when(has("giat s", "say"), "máy sấy").when(has("giat"), "máy giặt").when(has("bep"), "bếp từ").when(has("hut"), "máy hút mùi")
        out = out.when(has("lo"), "lò nướng").when(has("rua"), "máy rửa bát").when(has("xay", "blender"), "máy xay sinh tố").when(has("loc nuoc"), "máy lọc nước")
        return out.otherwise("")

    return let(normalize_text(sheet_name), noun)


def model_variants(model: Column) -> Column:
    """Spellings of a model: as is, without hyphens, blanks or anything but letters and digits; each in three cases."""
    m = F.trim(F.coalesce(model, F.lit("")))
    forms = F.array(m, F.regexp_replace(m, "[-_]", ""), F.replace(m, F.lit(" "), F.lit("")), F.regexp_replace(m, "[^a-zA-Z0-9]", ""))
    all_forms = F.concat(forms, F.transform(forms, lambda x: F.lower(x)), F.transform(forms, lambda x: F.upper(x)))
    return F.when(m != "", F.array_sort(F.array_distinct(all_forms))).otherwise(no_strings())


def keywords(brand: Column, model: Column, sheet_name: Column) -> Column:
    """Search phrases for a product, sorted by code point, each once; none without a model."""
    b, m = F.trim(F.coalesce(brand, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    lead = F.when(b != "", F.concat(b, F.lit(" "))).otherwise("")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    when = lambda test, *items: F.when(test, F.array(*items)).otherwise(no_strings())
    noun = category_keyword(sheet_name)
    base = F.regexp_extract(m, r"^(.*?\d+)[A-Za-z]+$", 1)
    variants = F.filter(model_variants(m), lambda v: v != m)
    found = F.concat(
        F.array(F.concat(lead, m), m, quoted(m), F.concat(lead, m, F.lit(" giá")), F.concat(lead, m, F.lit(" site:.vn"))),
        when(b != "", F.concat(lead, m, F.lit(" khuyến mãi"))),
        let(noun, lambda n: when(n != "", F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, F.lit(2), F.length(n)), F.lit(" "), lead, m))),
        when(F.lower(b) == "bosch", F.concat(F.lit("Bosch Series 8 "), m), F.concat(F.lit("Bosch Series 6 "), m)),
        when(base != "", F.concat(lead, base), base, quoted(base)),
        when((base != "") & (b != ""), F.concat(lead, base, F.lit(" giá"))),
        F.transform(variants, lambda v: F.concat(lead, v)), variants,
    )
    return F.when(m != "", F.array_sort(F.array_distinct(found))).otherwise(no_strings())
