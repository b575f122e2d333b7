"""Awkward inputs: quoting, tenants, text keys, dates, NaN, dotted names, other alphabets."""

import datetime as dt
import math

from pyspark.sql import functions as F

from wardlake.functions.scalars import key_mix, to_instant
from wardlake.operators import documents, model_eval, quality, retrieval, scorecard
from wardlake.sources import readers, tenants


def test_csv_round_trip_keeps_every_field(spark, tmp_path):
    rows = [(1, 'said "hi, you" now', "a,b"), (2, "two\nlines", '"'), (3, "plain", ""), (4, '{"k": 69}', "x")]
    frame = spark.createDataFrame(rows, "id int, text string, more string")
    path = f"{tmp_path}/upload.csv"
    readers.write_csv(frame, path)
    back = {r.id: (r.text, r.more or "") for r in readers.read_upload(spark, path).collect()}
    assert back == {i: (a, b) for i, a, b in rows}
    table = readers.read_csv_table(spark, path, ["id", "text", "more"], multi_line=True)
    assert {int(r.id): r.text for r in table.collect()} == {i: a for i, a, _ in rows}
    assert readers.dropped_lines(spark, path, ["id", "text", "more"], multi_line=True).first()[0] == 0


def test_tenants_that_look_like_numbers_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([("007", "a"), ("7", "b"), ("7", "c")], "tenant_id string, text string")
    path = f"{tmp_path}/store"
    tenants.append(rows, path, "1")
    assert {r.tenant_id: r.chunks for r in tenants.counts(spark, path).collect()} == {"007": 1, "7": 2}
    assert [r.text for r in tenants.read_store(spark, path, "007").collect()] == ["a"]


def test_text_keys(spark):
    frame = spark.range(400).select(
        F.md5(F.col("id").cast("string")).alias("stay"), (F.col("id") % 4 == 0).cast("int").alias("label")
    )
    split = model_eval.stratified_split(frame, "label", "stay")
    assert {(r.label, r.n) for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {(0, 60), (1, 20)}
    mixes = spark.createDataFrame([("7",), ("D12",), (None,)], "k string").select(key_mix(F.col("k")).alias("m")).collect()
    assert mixes[0].m == 7 * 2654435761 % 2**32 and 0 <= mixes[1].m < 2**32 and mixes[2].m is None
    people = spark.createDataFrame([("Heart", f"D{i}", f"n{i}", i) for i in range(5)], "department string, doctor_id string, doctor_name string, encounters bigint")
    pages = scorecard.provider_directory(people, 2).collect()
    assert sorted(x.doctor_id for p in pages for x in p.doctors) == [f"D{i}" for i in range(5)]


def test_dates_in_many_forms(spark):
    forms = ["2010-01-23", "01/23/2010", "1/23/2010 14:30", "2010/1/23", "1-23-2010", "23.1.2010", "Jan 23, 2010", "January 23, 2010", "23 Jan 2010", "20100123", "2010-01-23T00:00:00"]
    got = [r.d for r in spark.createDataFrame([(f,) for f in forms], "t string").select(to_instant(F.col("t")).alias("d")).collect()]
    assert [g.date() for g in got] == [dt.date(2010, 1, 23)] * len(forms) and got[2].hour == 14
    bad = spark.createDataFrame([("13/45/2010",), ("soon",), ("",), (None,)], "t string")
    assert [r.d for r in bad.select(to_instant(F.col("t")).alias("d")).collect()] == [None] * 4


def test_nan_and_names_with_dots(spark):
    frame = spark.createDataFrame([(1.0, 2.0, "x"), (math.nan, 4.0, None), (3.0, 6.0, "y"), (4.0, None, "z")], "`a.b` double, `c d` double, t string")
    missing = {r.column_name: r.missing for r in quality.null_counts(frame).collect()}
    assert missing == {"a.b": 1, "c d": 1, "t": 1}
    assert {r.column_name: r.distinct_values for r in quality.column_quality(frame).collect()} == {"a.b": 3, "c d": 3, "t": 3}
    r = {(x.column_x, x.column_y): x.r for x in quality.correlation_matrix(frame).collect()}
    assert math.isclose(r["a.b", "c d"], 1.0) and len(r) == 4


def test_correlation_covers_every_column(spark):
    wide = spark.range(50).select(*[(F.col("id") * (i + 1) + F.rand(i)).alias(f"n{i}") for i in range(30)])
    assert quality.correlation_matrix(wide).count() == 900


def test_words_of_other_alphabets(spark):
    text = "für die Übung, niño 中文"
    chunks = spark.createDataFrame([(1, text), (2, "ganz anderes")], "chunk_id int, text string")
    tokens = retrieval.fit_encoder(chunks).stages[0].transform(chunks).where("chunk_id = 1").first()["__tokens"]
    assert tokens == ["für", "die", "übung", "niño", "中文"]


def test_corpus_build_caps_only_usable_documents(spark):
    rows = [(f"{i}", "s", f"title {i}", "u", "x" * 50 if i % 2 else "word " * 60) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, title string, url string, text string")
    built = documents.balanced_cap(documents.corpus_filter(docs, ["s"]), [F.col("doc_id").cast("int")], 4)
    assert sorted(int(r.doc_id) for r in built.collect()) == [0, 2, 4, 6]
    chunks = documents.corpus_build(docs, ["s"], [F.col("doc_id").cast("int")])
    assert {r.doc_id for r in chunks.collect()} == {str(i) for i in range(0, 20, 2)}
    assert documents.oversized(docs, ["s"]).first().oversized == 0
