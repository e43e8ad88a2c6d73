"""Results that differed from SQL on larger tables: repeated URLs, keys that met by chance, protected rows, ties of doubles."""

import duckdb
from pyspark.sql import functions as F

from marketloom.functions import matching, money
from marketloom.operators import html, ranks
from marketloom.plans import relations
from marketloom.sources import search

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def agrees(spark, tmp_path, name, module=relations, **tables):
    """Whether a query over ``tables`` (rows, schema) gives the rows of its SQL."""
    with duckdb.connect() as con:
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.execute(module.ORACLES[name])
        columns, rows = [c[0] for c in want.description], want.fetchall()
    got = [tuple(r) for r in module.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
    return rows


def test_links_of_pages_that_share_a_url(spark, tmp_path):
    a = lambda h: f'<a class="c" href="{h}">Bếp</a>'
    pages = [(1, "https://shop.vn/", a("/bep-tu") + a("/bep-tu-bosch")), (2, "https://shop.vn/", a("/may-giat") + a("/bep-tu-bosch")), (3, "https://shop.vn/x", a("/quat"))], "page_id bigint, url string, html string"
    assert len(agrees(spark, tmp_path / "a", "category_pages", pages=pages)) == 4
    assert sorted(agrees(spark, tmp_path / "b", "site_category_links", pages=pages)) == [(1, 2), (2, 2), (3, 1)]


def test_odd_sizes_have_no_variant_however_many_parts(spark, tmp_path):
    part = [(k, "a b", "Brand#1", "T", size, 900.0) for k, size in ((0, 3), (1, 3), (2, None), (1_000_000, 2), (1_000_001, 4), (1_000_002, 6), (2_000_001, 5))]
    agrees(spark, tmp_path, "normalized_key_join", part=(part, PART))


def test_the_first_part_is_no_protected_row(spark, tmp_path):
    part = [(k, "a b", "Brand#1", "T", size, 900.0 + k / 7) for k, size in ((0, 3), (1, 6), (2, 4), (3, 15), (9, None))]
    assert len(agrees(spark, tmp_path, "sale_price_update", part=(part, PART))) == 5


def test_shares_are_rounded_as_doubles(spark):
    """Shares whose shortest decimal form ends in 5 at the tenth place, while the double is a little more or less, or a tie once scaled."""
    pairs = [(-440279036, 420524), (-406837417, 144584), (-447817382, 105423), (120000122, 115902), (1, 7), (0, 3)]
    got = spark.createDataFrame(pairs, "g bigint, b bigint").select("g", money.rounded_share(F.col("g") / F.col("b")).cast("decimal(20,9)").alias("s")).collect()
    with duckdb.connect() as con:
        want = [con.execute(f"SELECT {g}, round_even({g} / {b}, 9)::DECIMAL(20, 9)").fetchone() for g, b in pairs]
    assert [tuple(r) for r in got] == want


def test_outliers_of_one_key_are_many_tasks(spark, monkeypatch):
    """No join by key alone, however many spans there are: a frequent key's prices stay dealt over their ranges."""
    rows = spark.range(4000).select(F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("k"), F.when(F.col("id") < 20, F.col("id") * 100_000 + 1_000_000).otherwise(F.col("id") + 1).alias("price"))
    few = {(r.k, r.outlier_price) for r in ranks.price_outliers(rows, ["k"]).collect()}
    assert few == {(k, i * 100_000 + 1_000_000) for i in range(20) for k in ("b" if i == 0 else "a",)}
    monkeypatch.setattr(ranks, "BROADCAST_SPANS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = ranks.price_outliers(rows, ["k"])
        assert {(r.k, r.outlier_price) for r in out.collect()} == few
        joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert sum("span_" in line for line in joins) == 1 and "span_" in joins[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_that_nobody_asks_for_are_not_parsed(spark):
    pages = spark.createDataFrame([("b", "DI-1", "k", e, p, "<a href='https://x.vn/a'>x</a>") for e in search.ENGINES for p in (1, 2, 3)], "brand string, model string, keyword string, engine string, page int, html string")
    found = search.read_pages(pages)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsing = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert any("page#" in line and ("Filter" in line or "LocalRelation" in line) for line in lines[parsing + 1 :])
    assert {(r.engine, r.page) for r in found.collect()} == {(e, p) for e, n in search.PAGES.items() for p in range(1, n + 1)}


def test_a_page_is_judged_once_for_each_element(monkeypatch):
    """Words of a discount are looked for once in an element, however many prices stand in it, and each price is judged once."""
    folded, judged = [], []
    fold, is_junk = html._fold, html.is_junk
    monkeypatch.setattr(html, "_fold", lambda v: folded.append(v) or fold(v))
    monkeypatch.setattr(html, "is_junk", lambda n, *more: judged.append(id(n)) or is_junk(n, *more))
    root = html.parse("<body><div class='product-detail'>" + "<p class='price amount gia'>1.250.000đ</p>" * 20 + "<div><p>Tiết kiệm</p><p class='gia'>99.000đ</p></div></div></body>")
    found = html.price_candidates(root)
    assert {c["raw"] for c in found} == {"1.250.000đ"} and len(found) == 20 * 4
    assert len(judged) == len(set(judged)) == 21 and len(folded) == 23


def test_a_model_is_read_once_for_a_title_and_a_url(spark):
    rows = [("Bếp Kocher DI-1234 Plus", "https://s.vn/bep-di-1234", "DI-1234", "Kocher"), ("Bếp Kocher EI-1234", "https://s.vn/x", "DI-1234", "Kocher"), ("Kocher 12-34", "https://s.vn/1", "DI 1234", "Kocher"), (None, None, "DI-1", None), ("Kocher", "u", "", "Kocher"), ("Kocher", "u", "DI-7777", "Kocher")]
    table = spark.createDataFrame(rows, "t string, u string, m string, b string")
    t, u, m, b = (F.col(c) for c in "tumb")
    both = table.select(matching.judged_each({"t": t, "u": u}, m, b, lambda t, u, **rest: F.struct(t, u)).alias("s"), matching.judged(t, m, b).alias("t"), matching.judged(u, m, b).alias("u"), matching.prefix_conflict(t, m, b).alias("p"), matching.suffix_conflict(t, m, b).alias("x"))
    got = both.collect()
    assert all(tuple(r.s) == (r.t, r.u) and (r.p, r.x) == (r.t.prefix, r.t.suffix) for r in got)
    assert [r.reason for r in table.select(html.verify(t, u, m, b).alias("reason")).collect()] == ["Conflicting suffix found (extended model)", "Only brand matched, model missing", None, "Model not found", "Empty model", "Only brand matched, model missing"]
