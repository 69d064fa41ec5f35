"""CSV extraction, header rules, trims, missing files, typed projection."""

from __future__ import annotations

import datetime as dt
import os
import random
from collections import Counter
from decimal import Decimal

import pytest

from tradelens.contracts import CONTRACTS
from tradelens.sources import landing as landing_module
from tradelens.sources import quoted, typed
from tradelens.sources.landing import Landing
from tradelens.sources.quoted import text_lines


def write(tmp_dir, filename, text):
    with open(os.path.join(tmp_dir, filename), "w") as fh:
        fh.write(text)


ORDERS = "olist_orders_dataset.csv"


def read(spark, folder, dataset, **more):
    return Landing(spark, folder, **more).read(dataset)


def test_headers_are_normalised_and_values_trimmed(spark, tmp_dir):
    write(tmp_dir, ORDERS, " ORDER_ID , CUSTOMER_ID , ORDER_STATUS \n  o1 ,\tc1 , delivered \n")
    df = read(spark, tmp_dir, ORDERS, trim=True)
    assert df.columns == ["order_id", "customer_id", "order_status"]
    assert [tuple(r) for r in df.collect()] == [("o1", "c1", "delivered")]
    assert read(spark, tmp_dir, "orders").collect()[0]["order_id"] == "  o1 "


def test_empty_and_unexpected_columns_become_findings(spark, tmp_dir):
    columns = CONTRACTS["orders"].expected_columns
    write(tmp_dir, ORDERS, ",".join([*columns, "debug_column"]) + "\n")
    df = read(spark, tmp_dir, "orders")
    assert df.count() == 0 and "debug_column" in df.columns
    found = {r["check"]: r for r in typed.validate_text(df, CONTRACTS["orders"]).collect()}
    assert {k: v["severity"] for k, v in found.items()} == {"empty_dataset": "warning", "unexpected_columns": "warning"}
    assert ORDERS in found["empty_dataset"]["message"] and "debug_column" in found["unexpected_columns"]["message"]
    write(tmp_dir, CONTRACTS["sellers"].csv_filename, "")
    assert read(spark, tmp_dir, "sellers").columns == []


def test_absent_files_are_named_before_reading(spark, tmp_dir):
    write(tmp_dir, ORDERS, "order_id\no1\n")
    landing = Landing(spark, tmp_dir)
    with pytest.raises(FileNotFoundError, match="olist_customers_dataset.csv"):
        landing.read_all([ORDERS, "customers"])
    with pytest.raises(KeyError):
        landing.read_all(["nope.csv"])
    assert list(landing.read_all([ORDERS])) == ["orders"]


def test_colliding_headers_fail(spark, tmp_dir):
    write(tmp_dir, ORDERS, "order_id,ORDER_ID \no1,o2\n")
    with pytest.raises(ValueError, match="order_id"):
        read(spark, tmp_dir, ORDERS)


def test_no_break_spaces_are_trimmed(spark, tmp_dir):
    write(tmp_dir, ORDERS, "order_id,customer_id\n\u00a0o1\u00a0,\u2003c1 \n")
    assert [tuple(r) for r in read(spark, tmp_dir, ORDERS, trim=True).collect()] == [("o1", "c1")]


@pytest.mark.parametrize("row", ["s2,2,rio, de janeiro,RJ", "s3,3"])
@pytest.mark.parametrize("dataset", ["sellers", "order_reviews"])
def test_ragged_rows_stop_the_read(spark, tmp_dir, dataset, row):
    write(tmp_dir, CONTRACTS[dataset].csv_filename, f"a,b,c,d\ns1,1,x,SP\n{row}\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING|Malformed"):
        read(spark, tmp_dir, dataset).select("a").collect()


@pytest.mark.parametrize("dataset", ["sellers", "order_reviews"])
def test_every_file_of_a_dataset_has_the_same_header(spark, tmp_dir, dataset):
    folder = os.path.join(tmp_dir, CONTRACTS[dataset].csv_filename)
    os.mkdir(folder)
    write(folder, "a.csv", "seller_id,seller_zip_code_prefix\ns1,1\n")
    write(folder, "b.csv", "SELLER_ID,seller_zip_code_prefix\ns2,2\n")
    df = read(spark, tmp_dir, dataset)
    assert sorted(tuple(r) for r in df.collect()) == [("s1", "1"), ("s2", "2")]
    write(folder, "c.csv", "seller_zip_code_prefix,seller_id\n3,s3\n")
    with pytest.raises(Exception, match="header"):
        read(spark, tmp_dir, dataset).collect()


@pytest.fixture
def small_splits(spark):
    """Byte ranges of 64 bytes: most records reach over an edge."""
    conf = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


REVIEWS = CONTRACTS["order_reviews"].csv_filename


def multi_line(spark, path, names):
    """One task per file: Spark's own multi-line reader."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.options(**landing_module.READ_OPTIONS, multiLine=True).schema(schema).csv(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_reviews_equal_the_multi_line_read(spark, tmp_dir, small_splits, end):
    rng = random.Random(4)
    names = ["review_id", "order_id", "review_comment_message"]
    for part in range(3):
        rows = [names]
        for i in range(150):
            text = "".join(rng.choice(["word ", end, end, '""', ",", " ", "é", "x" * 30]) for _ in range(rng.randint(0, 25)))
            quoted = f'"{text}"' if rng.random() < 0.7 else rng.choice(["plain", "", '""', " "])
            rows.append([f"r{part}-{i}", rng.choice(["o1", '"o,2"', ""]), quoted])
        body = end.join(",".join(r) for r in rows) + rng.choice(["", end, end + end])
        folder = os.path.join(tmp_dir, REVIEWS)
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"{part}.csv"), "w", newline="") as fh:
            fh.write(body)
    lines = text_lines(spark, os.path.join(tmp_dir, REVIEWS))
    assert lines.select("file", "range").distinct().count() > 100
    got = Counter(tuple(r) for r in read(spark, tmp_dir, "order_reviews").collect())
    want = Counter(tuple(r) for r in multi_line(spark, os.path.join(tmp_dir, REVIEWS), names).collect())
    assert sum(got.values()) == 450
    assert got == want


def test_unpaired_quotes_and_ragged_records_stop_a_split_read(spark, tmp_dir, small_splits):
    good = "".join(f'r{i},"a{chr(10)}b"\n' for i in range(30))
    for bad, error in (('x,"open\n', "does not end"), ('x,"a\nb",more\n', "MALFORMED|Malformed"), ("x\n", "MALFORMED|Malformed")):
        write(tmp_dir, REVIEWS, "review_id,order_id\n" + good + bad + good)
        with pytest.raises(Exception, match=error):
            read(spark, tmp_dir, "order_reviews").collect()


def test_a_record_over_many_ranges_is_bounded(spark, tmp_dir, small_splits, monkeypatch):
    write(tmp_dir, REVIEWS, 'review_id,order_id\nr1,"' + "long line\n" * 200 + '"\nr2,o2\n')
    rows = sorted(tuple(r) for r in read(spark, tmp_dir, "order_reviews").collect())
    assert rows == [("r1", "long line\n" * 200), ("r2", "o2")]
    monkeypatch.setattr(quoted, "MAX_RECORD_BYTES", 500)
    with pytest.raises(Exception, match="longer than 500 bytes"):
        read(spark, tmp_dir, "order_reviews").collect()


def test_large_files_are_split(spark, tmp_dir):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for dataset in ("order_items", "order_reviews"):
            c = CONTRACTS[dataset]
            names = c.expected_columns
            lines = (",".join(f"{k}" for _ in names) for k in range(20_000))
            write(tmp_dir, c.csv_filename, "\n".join([",".join(names), *lines]) + "\n")
            assert read(spark, tmp_dir, dataset).count() == 20_000
            assert text_lines(spark, os.path.join(tmp_dir, c.csv_filename)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_bad_score_is_one_error(spark):
    df = spark.createDataFrame([("r1", "9"), ("r2", "5")], "review_id string, review_score string")
    found = [r["check"] for r in typed.validate_text(df, CONTRACTS["order_reviews"]).collect() if r["column"] == "review_score"]
    assert found == ["out_of_bounds"]


def test_typed_projection_counts_rejects(spark):
    c = CONTRACTS["order_items"]
    df = spark.createDataFrame(
        [("o1", "1", "p", "s", "2020-01-01 10:00:00", "1.005", "2"),
         ("o2", "x", "p", "s" * 40, "bad", "12345678.9", None)],
        ", ".join(f"{n} string" for n in c.expected_columns),
    )
    rows = {r["column"]: r["n_rows"] for r in typed.type_rejects(df, c).collect()}
    assert rows == {"order_item_id": 1, "seller_id": 1, "shipping_limit_date": 1, "price": 1}
    first = typed.to_typed(df, c).where("order_id = 'o1'").collect()[0]
    assert first["price"] == Decimal("1.01")  # half away from zero on the way in
    assert first["shipping_limit_date"] == dt.datetime(2020, 1, 1, 10)


def test_quarantine_has_a_row_per_counted_reject(spark):
    c = CONTRACTS["order_reviews"]
    rows = [("r1", "o1", "9", None), ("r" * 33, "o" * 40, "x", "2020-01-01 00:00:00"), ("r2", "o2", "5", "never")]
    df = spark.createDataFrame(rows, "review_id string, order_id string, review_score string, review_creation_date string")
    kept = typed.quarantined(typed.with_rejects(df, c), c).collect()
    counted = {r["column"]: r["n_rows"] for r in typed.type_rejects(df, c).collect()}
    assert Counter(r["column"] for r in kept) == counted and len(kept) == 5
    assert {r["reason"] for r in kept if r["column"] == "review_score"} == {"out of bounds", "not a smallint"}
    empty = typed.with_rejects(spark.createDataFrame([("x",)], "odd string"), c)
    assert typed.quarantined(empty, c).count() == 0


def test_enum_and_bounds_rejected(spark):
    o = CONTRACTS["orders"]
    df = spark.createDataFrame([("o1", "delivered"), ("o2", "lost")], "order_id string, order_status string")
    rows = {r["column"]: r["n_rows"] for r in typed.type_rejects(df, o).collect()}
    assert rows == {"order_status": 1}
    r = CONTRACTS["order_reviews"]
    df = spark.createDataFrame([("1",), ("9",)], "review_score string")
    assert {x["column"]: x["n_rows"] for x in typed.type_rejects(df, r).collect()} == {"review_score": 1}


def test_validation_and_rejects_in_one_aggregate(spark):
    c = CONTRACTS["order_items"]
    df = spark.createDataFrame(
        [("o1", "1", "p", "s", "2020-01-01 10:00:00", "-1.00", "2", "x"),
         ("o2", "x", "p", "s", None, "2.00", "1", None)],
        ", ".join(f"{n} string" for n in c.expected_columns) + ", debug string",
    )
    issues = typed.validate_text(df, c)
    got = {(r["check"], r["column"]): r["n_rows"] for r in issues.collect()}
    assert got[("type_rejected", "order_item_id")] == 1
    assert got[("negative_monetary", "price")] == 1
    assert got[("unexpected_columns", None)] == 2
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 3  # one for the checks, two for the key check
