import datetime as dt
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wardlake.functions import scalars as S
from wardlake.operators import typing
from wardlake.sources import layers, readers, snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def date(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    "birth,at,years",
    [
        ("2000-02-29", "2021-02-28", 20),
        ("2000-02-29", "2021-03-01", 21),
        ("2000-02-28", "2021-02-28", 21),
        ("1990-06-15", "1989-06-15", -1),
        ("1990-12-31", "2000-01-01", 9),
    ],
)
def test_years(spark, birth, at, years):
    assert one(spark, S.years_between(date(birth), date(at))) == years


@pytest.mark.parametrize(
    "name,expected",
    [("  City Hospital #3 ", "city_hospital_3"), ("__", "unnamed"), ("", "unnamed"), ("A-b_c", "a-b_c"), ("Ärzte", "rzte")],
)
def test_safe_id(spark, name, expected):
    assert one(spark, S.safe_id(F.lit(name))) == expected


def test_clean_text(spark):
    assert one(spark, S.clean_text(F.lit(" a \t b\r\rc\n\n\n\n d 　"))) == "a b\n\nc\n\n d"
    assert one(spark, S.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, S.clean_text(F.lit("\n\n \n"))) == ""


@pytest.mark.parametrize(
    "title,expected", [("Sepsis", "WHO: Sepsis"), ("None", "WHO (doc 12345678)"), (None, "WHO (doc 12345678)"), ("", "WHO (doc 12345678)")]
)
def test_citation(spark, title, expected):
    label = S.citation_label(F.lit("who"), F.lit(title).cast("string"), F.lit("1234567890"))
    assert one(spark, label) == expected


def test_key_mix_does_not_overflow(spark):
    assert one(spark, S.key_mix(F.lit(2**62 + 12345).cast("bigint"))) == ((2**62 + 12345) % 2**31 * 2654435761) % 2**32


def test_silver_bad_values_become_null(spark):
    columns = typing.KEPT["encounters"]
    good = dict.fromkeys(columns, "1") | {"start": "2020-01-02 03:04:05", "stop": "2020-01-05", "total_claim_cost": " 12.345 "}
    bad = dict.fromkeys(columns, "x") | {"start": "2020-13-01", "stop": "", "total_claim_cost": "abc"}
    rows = [tuple(r[c] for c in columns) for r in (good, bad)]
    out = typing.silver_encounters(spark.createDataFrame(rows, columns)).collect()
    assert out[0]["start"] == dt.datetime(2020, 1, 2, 3, 4, 5) and out[0]["stop"] == dt.datetime(2020, 1, 5)
    assert float(out[0]["total_claim_cost"]) == 12.35
    assert out[1]["start"] is None and out[1]["stop"] is None and out[1]["total_claim_cost"] is None
    assert out[1]["patient"] == "x"


def test_csv_drops_long_lines_and_pads_short_ones(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,2,3\n1,2,3,4\n5,6\n"x, ""y""",ü,\n')
    table = readers.read_csv_table(spark, str(path))
    assert table.columns == ["a", "b", "c"]
    assert sorted(map(tuple, table.collect()), key=str) == sorted(
        [("1", "2", "3"), ("5", "6", None), ('x, "y"', "ü", None)], key=str
    )
    assert table.count() == 3
    assert readers.dropped_lines(spark, str(path)).first()["dropped"] == 1


def test_read_tables_fails_on_missing(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_tables(spark, {"patients": str(tmp_path / "none.csv")})


def test_upload_extensions(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert readers.read_upload(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError):
        readers.read_upload(spark, str(tmp_path / "a.xlsx"))


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "text": "x"}\n\n   \n{"chunk_id": "b", "text": "ü\\n"}\n')
    rows = readers.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r["chunk_id"], r["text"]) for r in rows if r["chunk_id"]] == [("a", "x"), ("b", "ü\n")]
    assert len(rows) == 2


def test_questions_multi_line(spark, tmp_path):
    (tmp_path / "q.json").write_text(
        '{"description": "d", "questions": [\n {"id": 1, "question": "q", "relevant_doc_ids": ["a", "b"], "topic": "t"}]}'
    )
    (row,) = readers.read_questions(spark, str(tmp_path / "q.json"), multi_line=True).collect()
    assert row["relevant_doc_ids"] == ["a", "b"]


def test_bronze_headers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], ["Patient ID", "START"])
    for _ in range(2):
        layers.load_bronze(df, str(tmp_path), "x")
    back = layers.read_layer(spark, str(tmp_path), "bronze", "x")
    assert back.columns == ["patient_id", "start", "_loaded_at"] and back.count() == 1


def test_a_write_that_dies_leaves_the_table_as_it_was(spark, tmp_path):
    root, table = str(tmp_path), f"{tmp_path}/silver/x"
    with pytest.raises(FileNotFoundError):
        layers.read_layer(spark, root, "silver", "x")
    old = spark.range(5).withColumn("v", F.lit("old"))
    layers.write_silver(old, root, "x")
    kept = snapshots.current_version(spark, table)
    dies = spark.range(0, 100, 1, 4).withColumn("v", F.when(F.col("id") > 90, F.raise_error(F.lit("stopped half-way"))).otherwise("new"))
    with pytest.raises(Exception, match="stopped half-way"):
        layers.write_silver(dies, root, "x")
    assert snapshots.current_version(spark, table) == kept and len(os.listdir(f"{table}/versions")) == 2
    assert sorted(map(tuple, layers.read_layer(spark, root, "silver", "x").collect())) == [(i, "old") for i in range(5)]
    # a table may be replaced by what is read from it, while an earlier reader goes on
    reader = layers.read_layer(spark, root, "silver", "x")
    layers.write_silver(reader.where("id > 2"), root, "x")
    assert reader.count() == 5 and layers.read_layer(spark, root, "silver", "x").count() == 2
    gone = snapshots.remove_old(spark, table, keep=0)
    assert len(gone) == 2 and kept in gone and len(os.listdir(f"{table}/versions")) == 1
    assert layers.read_layer(spark, root, "silver", "x").count() == 2
    assert not [f for f in os.listdir(table) if f.startswith("_current.")]


def test_lookup_layout_lets_row_groups_be_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "LOOKUP_GROUP_BYTES", 20_000)
    rows = spark.range(120_000).select((F.col("id") * 7919 % 5003).alias("patient"), F.uuid().alias("note"))
    layers.write_silver(rows.repartition(6), str(tmp_path), "x", "patient")
    version = snapshots.current_version(spark, f"{tmp_path}/silver/x")
    groups = []
    for name in os.listdir(f"{tmp_path}/silver/x/versions/{version}"):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{tmp_path}/silver/x/versions/{version}/{name}").metadata
            for g in range(meta.num_row_groups):
                column = next(c for c in (meta.row_group(g).column(i) for i in range(2)) if c.path_in_schema == "patient")
                groups.append((column.statistics.min, column.statistics.max))
    hit = [g for g in groups if g[0] <= 4321 <= g[1]]
    assert len(groups) >= 20 and 1 <= len(hit) <= 2  # the others are skipped by their bounds
    found = layers.read_layer(spark, str(tmp_path), "silver", "x").where("patient = 4321")
    assert found.count() == rows.where("patient = 4321").count() > 0
    assert "PushedFilters: [IsNotNull(patient), EqualTo(patient,4321)]" in found._jdf.queryExecution().toString()
