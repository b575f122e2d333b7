import glob
import hashlib
import os
import random
import shutil

import pytest

from wardlake.llm import warc as w

PAGES = "page_id bigint, url string, html string, digest string, block int"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(n)


def expected(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= 100:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        revisit = page is not None and other is not None and other != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=repr)


def got(df):
    rows = df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, rows), key=repr)


def sample():
    rng = random.Random(11)
    rows = [(i, f"http://h{i % 7}.example/é {i}", rng.choice(["copy é " * 40, "short", None, "", f"<p>{rng.random()}" * 30])) for i in range(200)]
    return [*rows, (10**12, None, "far\r\n\r\naway " * 50_000), (10**12 + 1, "http://a\r\nX: y", "far\r\n\r\naway " * 50_000), (None, None, "copy é " * 40)]


def test_round_trip(spark, tmp_path):
    rows = sample()
    manifest = w.write_archives(frame(spark, rows), f"{tmp_path}/a", block_bytes=20_000, roll_bytes=2_000)
    listed = {r.file: r for r in manifest.collect()}
    files = {os.path.basename(f): f for f in glob.glob(f"{tmp_path}/a/*.warc.gz")}
    assert set(listed) == set(files) and len(files) > 3
    assert not os.path.exists(f"{tmp_path}/a/_temporary")
    for name, file in files.items():
        data = open(file, "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (listed[name].bytes, listed[name].sha256)
    assert sum(r.records for r in listed.values()) == len(rows)
    back = w.read_archives(spark, f"{tmp_path}/a")
    assert got(back) == expected(rows)
    for r in back.where("record_type = 'response'").collect():
        assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
    # the same pages, dealt otherwise, give the same files
    again = w.write_archives(frame(spark, rows[::-1], 5), f"{tmp_path}/b", block_bytes=20_000, roll_bytes=2_000)
    assert {(r.file, r.sha256) for r in again.collect()} == {(r.file, r.sha256) for r in listed.values()}


def test_skewed_page_ids(spark, tmp_path):
    rng = random.Random(12)
    html = lambda i: rng.choice(["copy " * 40, "", f"<p>{i}" * 40])
    shapes = {
        "outlier": [(i, f"u{i}", html(i)) for i in range(150)] + [(1 << 60, "far", "far" * 50)],
        "no_ids": [(None, f"u{i}", f"<p>{i}" * 40) for i in range(120)] + [(5, "u", "copy " * 40)],
        "one_id": [(3, f"u{i}", f"<p>{i % 60}" * 40) for i in range(60)],
    }
    for name, rows in shapes.items():
        manifest = w.write_archives(frame(spark, rows), f"{tmp_path}/{name}", block_bytes=4_000)
        assert manifest.count() >= 8, name  # many blocks, so many tasks
        assert got(w.read_archives(spark, f"{tmp_path}/{name}")) == expected(rows)


def test_only_the_files_of_the_manifest_are_read(spark, tmp_path):
    rows, path = sample()[:60], f"{tmp_path}/a"
    w.write_archives(frame(spark, rows), path, block_bytes=3_000)
    files = sorted(glob.glob(f"{path}/*.warc.gz"))
    with pytest.raises(FileExistsError):
        w.write_archives(frame(spark, rows[:3]), path)
    # a stale archive beside the others is none of the manifest's
    shutil.copy(files[0], f"{path}/part-999999-0000.warc.gz")
    assert got(w.read_archives(spark, path)) == expected(rows)
    whole = open(files[1], "rb").read()
    for altered in (whole[:-1], whole + whole, bytes([*whole[:-20], whole[-20] ^ 1, *whole[-19:]])):
        with open(files[1], "wb") as out:
            out.write(altered)
        with pytest.raises(Exception):
            w.read_archives(spark, path).count()
    os.remove(files[1])
    with pytest.raises(Exception):
        w.read_archives(spark, path).count()
    # a run that ended between its renames and the manifest
    shutil.rmtree(f"{path}/_manifest")
    with pytest.raises(FileNotFoundError):
        w.read_archives(spark, path)


def test_edges(spark):
    assert got(w.round_trip(frame(spark, []))) == []
    twice = [(1, "u", "z" * 200)] * 2 + [(2, "u", "z" * 200), (1, "u", "other")]
    rows = got(w.round_trip(frame(spark, twice)))
    assert sorted((r[0], r[3], r[4]) for r in rows if r[1] == 200) == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1)]
