"""Command line: python -m marketloom config | tabs | run | row | catalogue | cache-clear | update-price | notify."""

from __future__ import annotations

import argparse
import json
import sys
import time

from marketloom.config import Settings


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marketloom")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("config", help="show the settings")
    sub.add_parser("tabs", help="list the tabs of the captured workbook")
    run = sub.add_parser("run", help="price the rows of a tab")
    run.add_argument("--sheet", required=True)
    run.add_argument("--start-row", type=int, default=3)
    run.add_argument("--end-row", type=int)
    run.add_argument("--rows", help="such as '3, 5, 20-22'")
    row = sub.add_parser("row", help="price one product")
    for name in ("brand", "model"):
        row.add_argument(f"--{name}", required=True)
    for name in ("sheet", "list-price", "cost-price", "sale-price"):
        row.add_argument(f"--{name}", default="")
    sub.add_parser("catalogue", help="write the catalogue's variants as brand, model and id")
    sub.add_parser("cache-clear", help="empty the cache")
    update = sub.add_parser("update-price", help="write the price update of one variant")
    update.add_argument("variant_id", type=int)
    update.add_argument("price", type=int)
    update.add_argument("--write-log", action="store_true", help="append to the update log too")
    for name in ("brand", "model"):
        update.add_argument(f"--{name}", default="")
    notify = sub.add_parser("notify", help="print the message that would be sent")
    notify.add_argument("text")
    return top


def main(argv: list[str] | None = None) -> int:
    args, settings = parser().parse_args(argv), Settings.load()
    if args.command == "config":
        print(json.dumps(settings.shown(), indent=2))
        return 0
    if args.command == "notify":
        ok = bool(settings.notify_token and settings.notify_chat)
        print(json.dumps({"ok": ok, "parse_mode": "HTML", "text": args.text}))
        return 0
    from marketloom.plans.run import run_remembering
    from marketloom.session import get_session
    from marketloom.sources import cache, catalogue, sheets

    spark = get_session()
    if args.command == "tabs":
        page = spark.read.text(settings.workbook_path, wholetext=True).withColumnRenamed("value", "html") if settings.workbook_path else None
        for r in sheets.tab_names(sheets.read_raw(spark, settings.sheets_path), page).orderBy("position").collect():
            print(r.sheet_name)
    elif args.command == "catalogue":
        catalogue.id_sheet(spark, f"{settings.output_path}/variants").replace(catalogue.variants(catalogue.read(spark, settings.catalogue_path)))
    elif args.command == "cache-clear":
        cache.clear(spark, settings.cache_path)
    elif args.command == "update-price":
        change = spark.createDataFrame([(args.variant_id, args.brand, args.model, args.price, "success")], "variant_id bigint, brand string, model string, price bigint, status string")
        catalogue.price_updates(change).write.mode("append").parquet(f"{settings.output_path}/price_updates")
        if args.write_log:
            sheets.update_log(change).write.mode("append").parquet(f"{settings.output_path}/update_log")
    else:
        if args.command == "run":
            tab = sheets.find_sheet(sheets.read_raw(spark, settings.sheets_path), args.sheet)
            first = tab.select("headers").first()
            rows = sheets.typed_rows(tab, sheets.map_headers(first.headers if first else []), args.start_row, args.end_row, args.rows)
        else:
            values = (args.sheet, 3, "", args.brand, args.model, args.list_price, args.cost_price, args.sale_price, [])
            rows = spark.createDataFrame([values], "sheet_name string, row_number int, product_id string, brand string, model string, list_price string, cost_price string, sale_price string, market_prices array<bigint>")
        out = run_remembering(rows, spark.read.parquet(settings.links_path), spark.read.parquet(settings.pages_path), settings.cache_path, int(time.time() * 1000))
        out.results.write.mode("overwrite").parquet(f"{settings.output_path}/results")
        out.logs.unionByName(out.summary).write.mode("append").parquet(f"{settings.output_path}/logs")
    return 0


if __name__ == "__main__":
    sys.exit(main())
