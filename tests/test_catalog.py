"""Staging, catalog, files, numbering, joins of skewed tables, reports, the whole job and the stream."""

import csv
import glob
import io
import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from shopmill.functions.urls import search_url
from shopmill.operators import report
from shopmill.operators.catalog import expand_rows, to_catalog
from shopmill.operators.numbering import number_blocks
from shopmill.operators.rank import first_per_asin, limit_ranked, use_fallback
from shopmill.operators.skew import join_unique
from shopmill.operators.quarantine import only_pages
from shopmill.operators.shred import shred
from shopmill.plans.harvest import catalog_from_csv, harvest
from shopmill.queries import QUERIES
from shopmill.queries.catalogs import part_records
from shopmill.schemas import CATALOG_COLUMNS, RUNS, STAGE_COLUMNS
from shopmill.session import HarvestSettings
from shopmill.sources.csv_files import file_encodings, read_stage_csv, write_catalog, write_stage, written_files
from shopmill.sources.tables import read_runs, search_terms, seeds, write_runs
from shopmill.streaming.pages import arriving_pages, write_products

STAGE = (
    "product_seq bigint, title string, description string, short_description string, regular_price string, "
    "sale_price string, category string, images string, sku string, sizes string, colors string"
)


def stage(spark, *rows):
    return spark.createDataFrame(rows, STAGE)


PLAIN = (5, "Cup", "d", "s", "10.00", None, None, "x?fmt=webp", "B1", "", "")
SHOE = (7, "Shoe", "long\n\"text\"", "s", "10.00", "8.00", "Shoes", "", "B2", "M, L", "Red, Navy Blue")
BOOT = (9, "Boot", None, None, "20.00", None, "Shoes", None, None, "9", None)


def test_catalog_rows(spark):
    rows = to_catalog(stage(spark, SHOE, BOOT, PLAIN)).orderBy("ID").collect()
    assert rows[0].asDict().keys() - {"product_seq", "k"} == set(CATALOG_COLUMNS)
    assert [(r["ID"], r["Type"], r["Name"], r["Parent"]) for r in rows] == [
        (10000, "simple", "Cup", None),
        (10001, "variable", "Shoe", None),
        (10002, "variation", "Shoe - M", "id:10001"),
        (10003, "variation", "Shoe - M", "id:10001"),
        (10004, "variation", "Shoe - L", "id:10001"),
        (10005, "variation", "Shoe - L", "id:10001"),
        (10006, "variable", "Boot", None),
        (10007, "variation", "Boot - 9", "id:10006"),
    ]
    assert [r["Attribute 2 value(s)"] for r in rows[1:6]] == ["Red, Navy Blue", "Red", "Navy Blue", "Red", "Navy Blue"]
    assert [(r["Regular price"], r["Sale price"]) for r in rows] == [
        ("10.00", ""), ("", "8.00"), *[("10.00", "8.00")] * 4, ("", ""), ("20.00", "20.00"),
    ]
    assert (rows[0]["Categories"], rows[0]["Images"], rows[0]["Attribute 1 name"]) == ("Uncategorized", "x?fmt=jpg", "")
    assert rows[7]["Attribute 2 value(s)"] == "As shown in the figure"
    assert {(r["In stock?"], r["Visibility in catalog"]) for r in rows} == {("1000", "visible")}
    assert [r["Description"] for r in rows] == ["d", "long\n\"text\"", *[None] * 6]


def test_catalog_of_nothing(spark):
    assert to_catalog(stage(spark)).count() == 0


def test_a_product_with_very_many_pairs_is_streamed(spark):
    many = ",".join(str(i) for i in range(700))
    rows = expand_rows(stage(spark, (*SHOE[:9], many, many)))
    assert rows.agg(F.count("*"), F.max("k"), F.countDistinct("k")).first()[:] == (490001, 490000, 490001)


def test_a_large_product_is_made_by_several_tasks(spark):
    sizes, colors = (", ".join(f"{x}{i % 150}" for i in range(n)) + ",," for x, n in (("s", 300), ("c", 200)))
    df = stage(spark, (*SHOE[:9], sizes, colors), PLAIN, BOOT, (11, *BOOT[1:9], " ,x", None))
    split, whole = (expand_rows(df, limit) for limit in (1_000, 1 << 40))
    columns = [c for c in whole.columns if c not in ("sizes", "colors")]
    assert split.count() == whole.count() == 1 + 302 * 202 + 1 + 2 + 3
    assert split.select(columns).exceptAll(whole.select(columns)).count() == 0
    tasks = split.filter("k > 0 and product_seq = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 302 * 202 / 2


def test_numbers_are_dense_and_in_order(spark):
    keys = spark.range(0, 50000, 7).select((F.col("id") * 1000003 % 50021).alias("key"))
    sized = keys.withColumn("n", F.col("key") % 5)
    found = number_blocks(sized, "key", F.col("n"), 100).join(sized, "key").orderBy("key").collect()
    expected, start = [], 100
    for row in sorted(sized.collect()):
        expected.append(start)
        start += row["n"]
    assert [r["start_id"] for r in found] == expected


def test_numbering_plan_has_no_whole_table_task(spark):
    plan = number_blocks(spark.range(100).withColumnRenamed("id", "key"), "key", F.lit(2), 1)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in text and text.count("Window") == 2  # one per partition, one over partition sums


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_join_with_a_hot_key_loses_and_repeats_nothing(spark, how):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("key"))
    big = big.unionByName(spark.range(900).select(F.lit(-1).alias("id"), F.lit(1).alias("key")))  # equal rows
    unique = spark.range(0, 500, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("x")).unionByName(
        spark.createDataFrame([(1, 10)], "key bigint, x bigint")
    )
    if how in ("left_anti", "left_semi"):
        unique = unique.select("key")
    plain = big.join(unique, "key", how)
    found = join_unique(big, unique, "key", how, limit=50).select(*plain.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_split_over_tasks(spark):
    big = spark.range(20000).select(F.lit(1).alias("key"), "id")
    split = join_unique(big, spark.createDataFrame([(1, "x")], "key int, v string"), "key", limit=1000)
    assert split.count() == 20000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = join_unique(big, spark.createDataFrame([(1, "x")], "key int, v string"), "key", limit=1000)
        sizes = [r["count"] for r in shuffled.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20000 and len(sizes) > 4


LINKS = "page_id int, rank int, pos int, asin string"


def test_ranked_tables(spark):
    links = spark.createDataFrame(
        [(1, 2, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, "a"), (2, 5, 1, "c"), (2, 4, 2, "c")], LINKS
    )
    top = limit_ranked(links, 2)
    assert sorted((r["page_id"], r["asin"], r["place"]) for r in top.collect()) == [
        (1, "a", 2), (1, "b", 1), (2, "c", 1), (2, "c", 2),
    ]
    assert sorted((r["page_id"], r["asin"], r["rank"]) for r in first_per_asin(links).collect()) == [
        (1, "a", 1), (1, "b", 1), (2, "c", 4),
    ]
    other = spark.createDataFrame([(1, 9, 9, "z"), (3, 9, 9, "z")], LINKS)
    assert sorted(r["page_id"] for r in use_fallback(links, other).collect()) == [1, 1, 1, 2, 2, 3]


def test_limits_reduce_before_the_shuffle(spark):
    links = spark.range(1000).selectExpr("id % 2 AS page_id", "id AS rank", "id AS pos", "'a' AS asin")
    plan = limit_ranked(links, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_stage_files_keep_their_cells(spark, tmp_path):
    odd = (1, 'a, "b"\nc', "x\n\ny", "é", "1.00", None, "To/y:s", "i", "0012", "1,2", "Red")
    write_stage(stage(spark, odd, SHOE), str(tmp_path), "20250101_000000")
    names = sorted(p.split("/")[-1] for p in glob.glob(f"{tmp_path}/file=*"))
    assert names == ["file=Shoes_products_20250101_000000", "file=To_y_s_products_20250101_000000"]
    part = glob.glob(f"{tmp_path}/file=To*/*.csv")[0]
    content = open(part, encoding="utf-8").read()
    assert content.startswith("﻿Title,Description,Short description,Regular price,Sale_Price,Category")
    back = read_stage_csv(spark, f"{tmp_path}/*/*.csv").filter("SKU = '0012'").first()
    assert [back[c] for c in STAGE_COLUMNS] == ['a, "b"\nc', "x\n\ny", "é", "1.00", None, "To/y:s", "i", "0012", "1,2", "Red"]


def test_encodings(spark, tmp_path):
    header = ",".join(STAGE_COLUMNS)
    cells = {"utf-8": "é中", "utf-8-sig": "é中", "gbk": "中文", "gb18030": "中㐀", "iso-8859-1": "caféÿ"}
    for encoding, cell in cells.items():
        (tmp_path / f"{encoding}.csv").write_bytes(f'{header}\n{cell},"a\nb",,,,,,007,5,N/A\n'.encode(encoding))
    found = {r["file"].split("/")[-1][:-4]: r["encoding"] for r in file_encodings(spark, str(tmp_path)).collect()}
    assert found == {"utf-8": "utf-8", "utf-8-sig": "utf-8", "gbk": "gbk", "gb18030": "gb18030", "iso-8859-1": "iso-8859-1"}
    rows = {r["file"].split("/")[-1][:-4]: r for r in read_stage_csv(spark, str(tmp_path)).collect()}
    assert {name: row["Title"] for name, row in rows.items()} == cells
    assert {(r["Description"], r["SKU"], r["Sizes"]) for r in rows.values()} == {("a\nb", "007", "5")}


@pytest.mark.parametrize("size", [301, 1 << 20])
def test_records_cut_at_any_split(spark, tmp_path, size):
    """Rows of quotes, line breaks of both kinds and blank lines, against Python's own reader, in order over files."""
    draw = random.Random(3)
    pieces = ["a", "\n", '"', ",", "\r\n", "é", "中", "\n\n", "x" * 30, " ", ""]
    expected = []
    for name, end in (("a b", "\n"), ("b", "\r\n"), ("c", "\n")):
        rows = [[f"{name}{i}"] + ["".join(draw.choices(pieces, k=draw.randrange(5))) for _ in STAGE_COLUMNS[1:]] for i in range(25)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL).writerows([STAGE_COLUMNS, *rows])
        if name == "c":  # the last quote is not closed, and lines are blank
            out.write('\n\nlast,"open\n,1')
            rows.append(["last", "open\n,1"] + [""] * 8)
        (tmp_path / f"{name}.csv").write_bytes(("\ufeff" + out.getvalue()).encode("utf-8"))
        expected += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        back = read_stage_csv(spark, f"{tmp_path}/*.csv", str(tmp_path / "work"))
        assert spark.read.parquet(f"{tmp_path}/work/lines").select("file", "block").distinct().count() > (3 if size < 1000 else 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = back.orderBy("position").collect()
    assert len({r["position"] for r in rows}) == len(rows)
    assert [[r[c] or "" for c in STAGE_COLUMNS] for r in rows] == expected
    for encoding, cell in (("gb18030", "中㐀"), ("iso-8859-1", "caféÿ")):
        (tmp_path / encoding).mkdir()
        (tmp_path / encoding / "f.csv").write_bytes(f'h\n{cell},"{cell}\n{cell}"\n'.encode(encoding))
        row = read_stage_csv(spark, str(tmp_path / encoding)).first()
        assert (row["Title"], row["Description"]) == (cell, f"{cell}\n{cell}")


def test_no_records(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(",".join(STAGE_COLUMNS).encode())
    assert read_stage_csv(spark, str(tmp_path)).count() == 0


def test_catalog_keeps_its_order_through_files(spark, tmp_path):
    """Rows of one category written as several files come back in order, and the catalog is the same row for row."""
    rows = [(i, f"t{i}", "d\n" * (i % 4), "s", "1.00", None, "One", "i", str(i), "S,M" if i % 3 else None, "Red") for i in range(300)]
    df = stage(spark, *rows).repartition(5, "title")
    write_stage(df, f"{tmp_path}/stage", "s")
    direct, trip = to_catalog(df), catalog_from_csv(spark, f"{tmp_path}/stage/*/*.csv", str(tmp_path))
    columns = ["ID", "Type", "SKU", "Name", "Parent", "Attribute 1 value(s)"]
    assert direct.orderBy("ID").select(*columns).collect() == trip.orderBy("ID").select(*columns).collect()
    assert trip.orderBy("ID").select("k").collect() == trip.orderBy("product_seq", "k").select("k").collect()


def test_catalog_files(spark, tmp_path):
    write_stage(stage(spark, SHOE, BOOT, PLAIN), f"{tmp_path}/stage", "s")
    rows = catalog_from_csv(spark, f"{tmp_path}/stage/*/*.csv", str(tmp_path))
    write_catalog(rows, f"{tmp_path}/out")
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{tmp_path}/out/*.csv")))
    assert text.startswith("﻿ID,Type,SKU,Name,Published") and text.count("variation") == 5
    parents = {r["ID"] for r in rows.filter("Type = 'variable'").collect()}
    assert {r["Parent"] for r in rows.filter("Type = 'variation'").collect()} == {f"id:{i}" for i in parents}


def test_seeds(spark):
    found = seeds(spark, "apple, gaming mouse,,a+b").orderBy("term_pos").collect()
    assert [(r["term_pos"], r["term"]) for r in found] == [(0, "apple"), (1, "gaming mouse"), (3, "a+b")]
    assert "k=gaming+mouse&" in found[1]["search_url"]
    assert search_terms(spark.createDataFrame([(" , ",)], "line string")).count() == 0


def run(pos, ok, name, seconds, products=1):
    return (pos, f"u{pos}", ok, name, seconds, "w", products, None if ok else "boom")


def test_runs_written_again_replace_their_own(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = spark.createDataFrame([run(0, True, "a", 2.0), run(3_000_000_000, False, None, None)], RUNS)
    write_runs(first, path, "2025-01-01 a/b")
    write_runs(spark.createDataFrame([run(1, True, "b", 1.0)], RUNS), path, "007")
    write_runs(first, path, "2025-01-01 a/b")
    write_runs(first.limit(0), path, "007")
    rows = read_runs(spark, path).select("run_id", "term_pos").collect()
    assert sorted(map(tuple, rows)) == [("007", 1), ("2025-01-01 a/b", 0), ("2025-01-01 a/b", 3_000_000_000)]


def test_file_report_lists_written_files(spark, tmp_path):
    write_stage(stage(spark, SHOE, BOOT, PLAIN), f"{tmp_path}/stage", "s")
    files = written_files(spark, f"{tmp_path}/stage").collect()
    on_disk = glob.glob(f"{tmp_path}/stage/*/*.csv")
    sizes = {urlparse(r["path"]).path: r["bytes"] for r in files}
    assert sizes == {os.path.abspath(p): os.path.getsize(p) for p in on_disk}
    assert sum(r["rows"] for r in files) == 3
    names = {r["category_name"] for r in files} - {None}
    runs = spark.createDataFrame([run(i, True, name, 1.0) for i, name in enumerate([*sorted(names), "nothing"])], RUNS)
    listed = report.file_report(runs, written_files(spark, f"{tmp_path}/stage")).collect()
    assert {r["category_name"] for r in listed if r["path"]} == names
    assert [r["rows"] for r in listed if r["category_name"] == "nothing"] == [None]


def test_reports(spark, tmp_path):
    runs = spark.createDataFrame([run(0, True, "a", 2.0), run(1, False, None, 0.0, 0), run(2, True, "b", 4.0, 0)], RUNS)
    write_runs(runs, str(tmp_path / "runs"))
    runs = read_runs(spark, str(tmp_path / "runs"))
    total = report.run_summary(runs).first()
    assert (total["terms"], total["succeeded"], total["failed"], total["total_time"], total["average_time"]) == (3, 2, 1, 6, 2)
    assert total["success_ratio"] == "2/3" and round(total["success_percent"], 1) == 66.7
    assert [tuple(r) for r in report.failed_runs(runs).collect()] == [("u1", "boom")]
    terms = spark.createDataFrame([(0, "x"), (1, "y"), (9, "z")], "term_pos int, term string")
    assert sorted(tuple(r) for r in report.run_detail(terms, runs).collect()) == [
        (0, "x", "Success", "a"), (1, "y", "Failed", "N/A"),
    ]
    assert [r["category_name"] for r in report.useful_runs(runs).collect()] == ["a"]
    assert report.file_report(runs).count() == 2
    assert ("Unknown", "Failed", 1) in [tuple(r) for r in report.category_summary(runs).collect()]
    empty = report.run_summary(spark.createDataFrame([], RUNS)).first()
    assert (empty["terms"], empty["total_time"], empty["average_time"], empty["success_percent"]) == (0, None, None, None)


def shop(spark):
    terms = spark.createDataFrame([(0, "red shoe"), (1, "cup"), (2, "gone")], "term_pos int, term string")
    urls = {r["term"]: r["u"] for r in terms.withColumn("u", search_url(F.col("term"))).collect()}
    entry = "<p data-component-type='s-search-result'><a href='/dp/B00000000{}'>x</a></p>".format
    page = "<span id=productTitle>Product {}</span><b id=priceblock_ourprice>${}</b><p id=productDescription>Size: S, M.</p>".format
    rows = [
        (1, urls["red shoe"], entry(9)),
        (2, urls["red shoe"].replace("amazon.com", "amazon.cn"), entry(2) + entry(1) + entry(2)),
        (3, urls["cup"], entry(1) + entry(7)),
        *((10 + i, f"https://www.amazon.com/dp/B00000000{i}", page(i, i)) for i in (1, 2, 3)),
        (20, "https://www.amazon.com/x/dp/B000000001/ref", page("one", 5)),
    ]
    return terms, spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_whole_job(spark, tmp_path):
    terms, pages = shop(spark)
    at = F.lit("2025-01-01 00:00:00").cast("timestamp")
    out = harvest(spark, terms, pages, str(tmp_path), at=at, settings=HarvestSettings(products_per_page=3))
    # the newest copies of a search page and of a product page count
    assert [(r["product_seq"], r["title"], r["category"]) for r in out.stage.orderBy("product_seq").collect()] == [
        (0, "Product 2", "red shoe"), (1, "Product one", "red shoe"), (3, "Product one", "cup"),
    ]
    assert [(r["success"], r["category_name"], r["product_count"]) for r in out.runs.orderBy("term_pos").collect()] == [
        (True, "red shoe", 2), (True, "cup", 1), (False, None, 0),
    ]
    assert [r["ID"] for r in out.catalog.orderBy("ID").collect()] == list(range(10000, 10009))
    # Product 3 is in no list; of the other two products the newest pages are read, and no page else
    assert out.products.count() == 2
    read = {r["page_id"] for r in out.parsed.collect()}
    named = {r["page_id"] for r in out.products.collect()}
    assert named < read and out.products.filter("title = 'Product 3'").isEmpty()
    assert all("/s?k=" in r["url"] for r in pages.collect() if r["page_id"] in read - named)


def test_only_wanted_pages_reach_the_tokenizer(spark):
    pages = spark.range(50).selectExpr("id as page_id", "'u' as url", "concat('<h1>', id, '</h1>') as html")
    ids = spark.createDataFrame([(7,), (8,), (99,)], "page_id bigint")
    for limit, join in ((10, "BroadcastHashJoin"), (2, "Join")):
        found = shred(only_pages(pages, ids, limit))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("LeftSemi")  # the join is below, on page_id
        assert join in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["page_id"], r["text"]) for r in found.collect()) == [(7, "7"), (8, "8")]


def test_routes_and_older_copies(spark, tmp_path):
    good, poor = "<span id='productTitle'>Good {}</span>".format, "<p>nothing to read</p>"
    dp = "https://www.amazon.com/dp/B00000000{}".format
    search = "<div data-component-type='s-search-result'><a href='/dp/B00000000{}'>x</a></div>".format
    rows = [
        (1, "https://www.amazon.com/s?k=cup&s=exact-aware-popularity-rank&language=en_US&currency=USD",
         "".join(search(i) for i in range(1, 6))),
        (10, dp(1), good("old")), (11, dp(1), good("older but read")), (12, dp(1), poor),
        (20, dp(2), good("x").replace("<", " Request was throttled. Please wait a moment and refresh the page <", 1)),
        (21, "https://www.amazon.co.uk/dp/B000000003", good("regional")),
        (30, dp(4), poor), (40, dp(5), None), (41, None, good("no address")), (42, "https://x.example/dp/B000000005", "x"),
        (50, dp(9), poor),  # no list names it
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    terms = spark.createDataFrame([(0, "cup")], "term_pos bigint, term string")
    out = harvest(spark, terms, pages, str(tmp_path))
    assert {(r["page_id"], r["title"]) for r in out.products.collect()} == {(11, "Good older but read"), (21, "Good regional")}
    assert {r["page_id"]: r["reason"] for r in out.refetch.collect()} == {
        12: "no title and no price", 20: "throttled", 30: "no title and no price", 40: "empty page", 41: "no address",
        42: "redirected",
    }
    assert sorted(r["page_id"] for r in out.parsed.collect()) == [1, 10, 11, 12, 21, 30]
    assert [r["product_count"] for r in out.runs.collect()] == [2]


def test_stream_gives_the_records_of_the_batch(spark, tmp_path):
    _, pages = shop(spark)
    folders = [str(tmp_path / name) for name in ("in", "out", "checkpoint")]
    for part in (pages.filter("page_id < 12"), pages.filter("page_id >= 12")):
        part.write.mode("append").parquet(folders[0])
        write_products(arriving_pages(spark, folders[0]), folders[1], folders[2]).awaitTermination()
    found = spark.read.parquet(folders[1]).orderBy("page_id").collect()
    assert [(r["page_id"], r["title"]) for r in found] == [
        (11, "Product 1"), (12, "Product 2"), (13, "Product 3"), (20, "Product one"),
    ]


def test_null_keys_are_spread_over_tasks(spark):
    big = spark.range(4000).select(F.lit(None).cast("int").alias("key"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("left", "left_anti"):
            unique = spark.createDataFrame([(1,)], "key int")
            joined = join_unique(big, unique, "key", how, limit=100)
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 4000 and len(sizes) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_catalog_without_adaptive_execution(spark):
    with_it = [tuple(r) for r in to_catalog(stage(spark, SHOE, BOOT, PLAIN)).orderBy("product_seq", "k").collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        without = [tuple(r) for r in to_catalog(stage(spark, SHOE, BOOT, PLAIN)).orderBy("product_seq", "k").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert with_it and with_it == without


def test_no_times_give_no_total(spark):
    runs = spark.createDataFrame(
        [(True, None), (False, None)], "success boolean, execution_time double"
    )
    row = report.run_summary(runs).first()
    assert (row["terms"], row["total_time"], row["average_time"]) == (2, None, None)
    half = report.run_summary(runs.unionByName(spark.createDataFrame([(True, 4.0)], runs.schema))).first()
    assert (half["total_time"], half["average_time"]) == (4.0, 4.0)


def test_parts_are_dealt_and_their_staging_rows_made_once(spark, tmp_path):
    rows = [(i, "thing", "Brand#1", "TIN", i % 9, 10.0 + i) for i in range(40)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert part_records(spark, str(tmp_path)).rdd.getNumPartitions() == tasks > 1
    counts = QUERIES["catalog_counts"](spark, str(tmp_path))
    # numbers, base rows and variations start from written rows: no list of sizes is looked for again
    assert "regexp" not in counts._jdf.queryExecution().optimizedPlan().toString().lower()
    found = {(row["kind"], row["category"]): row["rows"] for row in counts.collect()}
    # 10 parts with 3 sizes by 2 colours, 10 with 3 sizes by 1 colour, 20 without sizes
    assert sum(n for (kind, _), n in found.items() if kind == "variable") == 20
    assert found["variation", None] == 10 * 6 + 10 * 3
    assert sum(n for (kind, _), n in found.items() if kind == "simple") == 20
