"""Scalar vectors for the Column functions."""

import pytest
from pyspark.sql import functions as F

from marketloom.functions import matching, money, text, urls


def run(spark, rows, names, **columns):
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return df.select(*[c.alias(k) for k, c in columns.items()]).collect()


def one(spark, values, fn):
    return [r.x for r in run(spark, values, ["v"], x=fn(F.col("v")))]


def test_price_text(spark):
    given = ["9,120,000₫", " 11.340.000 đ ", "Liên hệ", "850", "689", "1.458.000", "14.74 triệu", "14,74 tr", "14740k", "14.7k", "11800000.00", "11.800.000,00 VNĐ", "11800000.00đ", "11800000.5", "15000", "", None]
    want = [9120000, 11340000, None, 850000, 689000, 1458000, 14740000, 14740000, 14740000, 14700000, 11800000, 11800000, 11800000, 11800000, 15000, None, None]
    assert one(spark, given, money.parse_price_text) == want


def test_price_number(spark):
    assert one(spark, ["850", "15000", "9120000", "0", None], lambda c: money.parse_price_number(c.cast("double"))) == [850000, 15000000, 9120000, None, None]


def test_price_shape(spark):
    given = ["12.500.000 đ", "1.200.000₫", "Liên hệ", "0987654321", "18001234", "15.5k", "12.0", None]
    assert one(spark, given, money.is_price_shaped) == [True, True, False, False, False, False, False, False]


def test_fake_price(spark):
    rows = [("12345000", "12345"), ("12340000", "12345"), ("12345", "12345"), ("9999000", "DI-333")]
    got = run(spark, rows, ["p", "m"], x=money.is_fake_price(F.col("p").cast("bigint"), F.col("m")))
    assert [r.x for r in got] == [False, False, True, False]


def test_normalize_model(spark):
    given = ["DI-333 Pro", " x-nano 6 plus ", "LUVIA350 BLACK (90 cm)", "LUVIA-350 BLACK 900mm", "LUVIA-350 BLACK 0.9m", "KF-IH870Z+", "KF-IH870Z Plus", "", None]
    want = ["DI333PRO", "XNANO6PLUS", *["LUVIA350BLACK90"] * 3, *["KFIH870ZPLUS"] * 2, "", ""]
    assert one(spark, given, text.normalize_model) == want


def test_clean_model_specs(spark):
    given = ["K-226I Bạc-70cm", "K-226V Đen-70cm", "K-225C Pro 70cm", "K-225C Pro", "KF-HID7348II", "KF-LUX AT90H-WH (Trắng)", "KF-991B New Black", "KF-GB027 (Kính đen)"]
    want = ["K-226I", "K-226V", "K-225C Pro", "K-225C Pro", "KF-HID7348II", "KF-LUX AT90H-WH", "KF-991B", "KF-GB027"]
    assert one(spark, given, text.clean_model_specs) == want


def test_row_selection(spark):
    assert one(spark, ["3, 5, 20-22", " 10 ", "", "abc, xyz-123", "-5", "9-7", None], text.parse_row_selection) == [[3, 5, 20, 21, 22], [10], None, None, None, [7, 8, 9], None]


def test_keywords(spark):
    rows = [("Bosch", "WQB245B40", "08.Giặt sấy"), ("Samsung", "QA65QN90A", "Tivi"), ("Bosch", "", "")]
    a, b, c = (r.x for r in run(spark, rows, ["b", "m", "s"], x=text.keywords(F.col("b"), F.col("m"), F.col("s"))))
    assert {"Bosch WQB245B40", "WQB245B40", '"WQB245B40"', "Bosch WQB245B40 giá", "Bosch WQB245B40 site:.vn", "Máy sấy Bosch WQB245B40", "Bosch Series 8 WQB245B40"} <= set(a)
    assert {"Samsung QA65QN90", "QA65QN90", '"QA65QN90"', "Samsung QA65QN90 giá"} <= set(b)
    assert a == sorted(a) and c == []


def test_small_text_functions(spark):
    assert one(spark, ["Đồ gia dụng ", "ÉÀ", None], text.normalize_text) == ["do gia dung", "ea", ""]
    assert one(spark, ["a [x] (y) | b", None], text.clean_title) == ["a b", ""]
    assert one(spark, ["&amp;lt;", "&#39;"], text.decode_entities) == ["<", "'"]
    assert one(spark, ["123456789", "1234", "", None], text.mask_secret) == ["1234****6789", "****", "", ""]
    assert one(spark, ["0", "25", "26", "701", "702"], lambda c: text.column_letter(c.cast("int"))) == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, ["12.0", " 7 ", None], text.clean_numeric_code) == ["12", "7", ""]
    assert one(spark, ["b, a,,b ", None], text.selected_sheet_names) == [["b", "a"], []]
    assert one(spark, ["Bếp từ Kocher DI-333 Pro", "Máy Bosch SMS6ZCI49E", "không có"], text.model_from_title) == ["DI-333", "SMS6ZCI49E", None]
    assert one(spark, ["https://docs.google.com/spreadsheets/d/aB-1_x/edit", "none"], text.sheet_id) == ["aB-1_x", ""]
    assert one(spark, ['docs-sheet-tab-caption">A &amp; B<x docs-sheet-tab-caption">A &amp; B<', '[0,0,"T1"][0,0,"T2"]'], text.sheet_names_from_html) == [["A & B"], ["T1", "T2"]]


@pytest.mark.parametrize(
    ("url", "model", "brand", "low", "high"),
    [
        ("https://shop.vn/bep-tu-kocher-di-332pro.html", "DI-332Pro", "Kocher", 240, 240),
        ("https://shop.vn/collections/bep-tu?q=kocher", "DI-332Pro", "Kocher", 0, 49),
        ("https://shop.vn/kocher-di-332pro-plus.html", "DI-332Pro", "Kocher", 0, 0),
    ],
)
def test_relevance(spark, url, model, brand, low, high):
    got = run(spark, [(url, model, brand)], ["u", "m", "b"], x=urls.relevance_score(F.col("u"), F.col("m"), F.col("b")))[0].x
    assert low <= got <= high


def test_urls(spark):
    assert one(spark, ["https://example.com/", "https://example.com/index.html", "https://example.com/products/item1", "invalid_url"], urls.is_homepage) == [True, True, False, False]
    bing = "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9rb2NoZXIudm4vZGktMzMzcHJv&someother"
    assert one(spark, [bing, "https://kocher.vn/x"], urls.decode_bing) == ["https://kocher.vn/di-333pro", "https://kocher.vn/x"]
    assert one(spark, ["/url?q=https://kocher.vn/di-333pro&other=1", "https://kocher.vn/di-333pro", "#top"], urls.normalize_href) == ["https://kocher.vn/di-333pro"] * 2 + [None]
    given = ["https://kocher.vn/bep-tu-kocher-di-333pro.html", "https://dienmayxanh.com/san-pham/di-333pro", "https://kocher.vn/danh-muc/bep-tu", "https://google.com/search?q=123"]
    assert one(spark, given, lambda u: urls.is_detail_url(u, F.lit("DI-333Pro"), F.lit("Kocher"))) == [True, True, False, False]
    rows = [("footer-area", "some-class"), ("main-content", "sidebar"), ("main-content", "product-item")]
    assert [r.x for r in run(spark, rows, ["i", "c"], x=urls.is_excluded(F.col("i"), F.col("c")))] == [True, True, False]
    rows = [("main-layout", "row", "div"), ("product-item", "col-md-4", "div")]
    assert [r.x for r in run(spark, rows, ["i", "c", "t"], x=urls.is_layout(F.col("i"), F.col("c"), F.col("t")))] == [True, False]
    rows = [("Bếp điện từ", "/bep-dien-tu"), ("Tin tức mới nhất", "/tin-tuc")]
    assert [r.x for r in run(spark, rows, ["t", "p"], x=urls.matches_category(F.col("t"), F.col("p")))] == [True, False]
    base = F.lit("https://a.vn/x/y.html")
    assert one(spark, ["https://b.vn/z", "//c.vn/z", "/z", "z"], lambda h: urls.absolute(base, h)) == ["https://b.vn/z", "https://c.vn/z", "https://a.vn/z", "https://a.vn/x/z"]


def test_model_match(spark):
    rows = [
        ("Bếp từ Kocher DI-333Pro chính hãng", "DI-333Pro", "Kocher", True), ("Bếp từ Kocher DI-333Pro Plus", "DI-333Pro", "Kocher", False),
        ("Bếp từ Kocher DI-888", "DI-333Pro", "Kocher", False), ("Bếp EI-333 Pro", "DI-333Pro", "", False), ("Bosch PID675DC1E", "PID675DC1E", "Bosch", True),
    ]
    got = run(spark, [r[:3] for r in rows], ["t", "m", "b"], x=matching.model_match(F.col("t"), F.col("m"), F.col("b")))
    assert [r.x for r in got] == [r[3] for r in rows]


def test_blocking_keys_lose_no_match(spark):
    """Every pair that matches without a brand shares a key: titles x models, all of them."""
    models = ["SU-9999", "SU 9999 Plus", "K70I5", "KOCHER PRO", "DI-330", "EI 88-77", "4411", "AQ-12", "MAGNA", "Máy-1234", "sms46x e-1", "HB 7"]
    titles = [f"Bep tu {m} chinh hang" for m in models] + ["Bep Kocher SU-99-99", "su9999plus", "KOCHERPRO", "x4411y", "EI8877", "DI330GB", "SU-19999", "Magna III", "may 12-34", "", "k70i5", "HB7"]
    pairs = spark.createDataFrame([(t, m) for t in titles for m in models], "title string, model string")
    seen = pairs.select("title", "model", matching.model_match(F.col("title"), F.col("model"), F.lit("")).alias("match"), F.arrays_overlap(matching.blocking_keys(F.col("title")), matching.blocking_keys(F.lit(""), F.col("model"))).alias("met")).collect()
    matched = [r for r in seen if r.match]
    assert len(matched) > len(models) and all(r.met for r in matched)
    assert ("Bep Kocher SU-99-99", "SU-9999") in {(r.title, r.model) for r in matched}
    assert sum(r.met for r in seen) < len(seen) / 2
