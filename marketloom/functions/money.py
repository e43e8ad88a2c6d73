"""Prices in Vietnamese notation, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.base import let
from marketloom.functions.text import normalize_text

#: The range in which a price is believed, in dong.
LOWEST, HIGHEST = 100_000, 2_000_000_000

# Patterns of the price notation.
_SIGNAL = (
    r"(?iU)₫|vnd|vnđ|dong|đồng|\b(gia|giá|sale|khuyen mai|khuyến mãi|special price|current price|product:price)\b"
    r"|[0-9]\s*[dđ₫]\b|[0-9]\s*[dđ₫]$|[0-9]\s*(k|tr|trieu|triệu)\b|[0-9]\s*(k|tr|trieu|triệu)$"
)
_PURE = r"^\s*([+-]\s*)?[0-9]{1,3}(?:[.,\s]?[0-9]{3})*(?:[.,][0-9]+)?\s*$|^\s*[0-9]+(?:[.,][0-9]+)?\s*$"
_CURRENCY_WORDS = ("-", "_", "vnd", "vnđ", "dong", "đồng", "trieu", "triệu", "₫", "đ", "d", "tr", "k")
_SPEC = r"(?iU)[a-z][0-9]|[0-9][a-z]|\b(w|kw|cm|mm|hz|db|sp|sku|model|brand|nhan|hieu|dien[\s_-]*may|dienmay|dienmayxanh|chefzone|kocher|bep247)\b"
_DECIMAL_TAIL = r"(?iu)[.,]([0-9]{1,2})\s*(?:[₫đ]|vnd|vnđ|dong|đồng)?$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _scaled(text: Column, pattern: str, factor: int) -> Column:
    """The number before a unit, times ``factor``, rounded half to even; NULL if the unit isn't there."""
    number = F.regexp_extract(text, pattern, 1)
    return F.when(number != "", F.bround(F.replace(number, F.lit(","), F.lit(".")).cast("double") * factor).cast("long"))


def parse_price_text(value: Column) -> Column:
    """A written price in dong; NULL for what is no price (words, phone numbers, model codes, specifications)."""

    def parsed(text: Column) -> Column:
        signal = F.lower(text).rlike(_SIGNAL)
        cleaned = F.lower(text)
        for word in _CURRENCY_WORDS:
            cleaned = F.replace(cleaned, F.lit(word), F.lit(""))
        folded = F.replace(normalize_text(text), F.lit(" "), F.lit(""))
        plain = _digits(F.regexp_replace(text, _DECIMAL_TAIL, ""))
        value_of = lambda f: F.coalesce(
            _scaled(f, r"([0-9]+(?:[.,][0-9]+)?)(?:trieu|tr)(?:\b|$)", 1_000_000), _scaled(f, r"([0-9]+(?:[.,][0-9]+)?)k(?:\b|$)", 1_000), plain.try_cast("bigint")
        )
        bad = lambda c, f: (
            (F.length(text) == 0) | (F.length(text) > 60) | ~(signal | text.rlike(_PURE)) | c.rlike(_SPEC)
            | (c.rlike("(?i)[a-z]") & (F.size(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)+|[0-9]+"), F.lit(0))) > 1))
            | (_digits(text).startswith("0") & (F.length(_digits(text)) > 5)) | f.contains("lienhe")
        )
        raw = let(folded, lambda f: let(F.trim(cleaned), lambda c: F.when(~bad(c, f), value_of(f))))
        return let(raw, lambda v: F.when(v > 0, F.when((v < 100_000) & ((v < 1_000) | signal), v * 1_000).otherwise(v)))

    return let(F.trim(value), parsed)


def rounded_share(share: Column) -> Column:
    """A share at nine places, half to even, by double arithmetic: a tie is one of the scaled number, not of its shortest decimal form."""
    return F.rint(share * 1e9) / 1e9


def parse_price_number(value: Column) -> Column:
    """A price given as a number: rounded half to even, and thousands if under 100,000."""
    return let(F.bround(value.cast("double")).cast("long"), lambda v: F.when(v > 0, F.when(v < 100_000, v * 1_000).otherwise(v)))


def is_price_shaped(text: Column) -> Column:
    """A stricter test for text nodes: only digits, separators and a currency; no phone or hotline numbers."""

    def shaped(t: Column) -> Column:
        currency = t.rlike("đ|₫|vnd|vnđ|\\$")
        phone = _digits(t).rlike("^0[0-9]{9}$|^1[89]00[0-9]{4}$")
        only = F.regexp_replace(F.regexp_replace(t, r"[0-9.,\sđ₫$%\-]", ""), "vnd|vnđ", "") == ""
        one_decimal = F.regexp_replace(t, "[^0-9.,]", "").rlike(r"[.,][0-9]$") & ~t.contains("$")
        return (t != "") & ~phone & only & t.rlike("[0-9]") & F.when(currency, ~one_decimal).otherwise(t.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$"))

    return let(F.lower(F.trim(F.coalesce(text, F.lit("")))), shaped)


def is_fake_price(price: Column, model: Column) -> Column:
    """Whether a price is made of the model's digits; round thousands never are."""
    p, m = price.cast("string"), _digits(F.coalesce(model, F.lit("")))
    return F.coalesce((F.length(m) >= 3) & (price % 1000 != 0) & (p.contains(m) | ((F.length(p) >= 4) & m.contains(p))), F.lit(False))


def price_bounds(reference: Column) -> tuple[Column, Column]:
    """The plausible range around a reference price; without one, the range of all prices."""
    known = F.coalesce(reference, F.lit(0)) > 0
    low = F.when(known, F.greatest(F.lit(float(LOWEST)), 0.3 * reference)).otherwise(float(LOWEST))
    high = F.when(known, F.least(F.lit(float(HIGHEST)), 2.0 * reference)).otherwise(float(HIGHEST))
    return low, high


def is_plausible(price: Column, reference: Column, model: Column) -> Column:
    low, high = price_bounds(reference)
    return F.coalesce(price.between(low, high), F.lit(False)) & ~is_fake_price(price, model)


def is_accepted(price: Column) -> Column:
    return F.coalesce(price.between(LOWEST, HIGHEST), F.lit(False))


def format_dong(value: Column) -> Column:
    """Thousands parted by points and the currency sign; '-' for nothing."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, "-").otherwise(F.concat(F.translate(F.format_number(value, 0), ",", "."), F.lit(" đ")))


def sheet_number(cell: Column) -> Column:
    """The sheet script's looser reading: all digits, and thousands if under 100,000."""
    return let(_digits(F.coalesce(cell, F.lit(""))).try_cast("bigint"), lambda v: F.when(v > 0, F.when(v < 100_000, v * 1_000).otherwise(v)))
