"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, committed by manifest.

Writing takes one pass for payload digests, which are grouped to find what repeats, and one shuffle of the payloads
into blocks of neighbouring page ids (of digests, where one id has more rows than a block). A task sorts its block and
streams the records, one gzip member each, into files
under temporary names, which no other attempt shares; a file that has reached ``roll_bytes`` compressed bytes is
followed by the next. What a task wrote comes back as manifest rows. Spark commits these once per task, so the manifest
names exactly one complete file per final name; a second job renames them, and what failed attempts left is removed.
The manifest is written last: a folder without it is not an archive. Archives go into a folder that holds nothing yet.

Reading takes the manifest's files and no others, as streams, and checks every file's bytes, records and SHA-256
against it, and every record's digests.

Blocks, record order, headers and record ids depend only on the pages, so the same pages give the same archives byte
for byte, on any cluster.

Of records with equal payloads of at least ``min_revisit_bytes`` the one with the smallest page id is a response and
the others revisit it, in the identical-payload-digest profile.

Defined results: null html is an empty payload; a null url leaves the target URI out; rows without page_id are always
responses; of repeated rows with one page_id and payload the first is the response, and these are the only rows that
must share a task; an empty table writes no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm.ranges import Blocks
from wardlake.llm.words import arrow_rows
from wardlake.session import materialize, scratch_path

MIN_REVISIT_BYTES = 100
# Payload bytes of one block of page ids, and compressed bytes after which a file is closed.
BLOCK_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
CREATED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COMPRESSION = 6
READ_BYTES = 1 << 16
# Tasks that read an archive at most.
MAX_READERS = 10_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_MANIFEST = "file string, written string, records bigint, bytes bigint, sha256 string"


def record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{repeat}')}>"


def _http(length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers)]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, repeat: int) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP head alone."""
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, repeat)),
        ("WARC-Date", CREATED),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if page_id is not None:
        headers.append(("WARC-Page-Id", str(page_id)))
    headers.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("WARC-Refers-To-Page-Id", str(refers_to)),
        ]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _member(headers, _http(len(payload)) + (b"" if revisit else payload))


class _Files:
    """Writes members into files of one block after another."""

    def __init__(self, path: str, roll_bytes: int) -> None:
        self.files, self.path = fs.FileSystem.from_uri(path)
        self.roll_bytes = roll_bytes
        self.out = None
        self.block, self.number = None, 0

    def add(self, block: int, member: bytes) -> Iterator[tuple]:
        if self.out is not None and (block != self.block or self.size >= self.roll_bytes):
            yield self.close()
        if block != self.block:
            self.block, self.number = block, 0
        if self.out is None:
            self.name = f"part-{block:06d}-{self.number:04d}.warc.gz"
            self.written = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(f"{self.path}/{self.written}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self.number += 1
            self._put(self._info())
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.sha.update(data)

    def _info(self) -> bytes:
        headers = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>"),
            ("WARC-Date", CREATED),
            ("WARC-Filename", self.name),
            ("Content-Type", "application/warc-fields"),
        ]
        return _member(headers, b"format: WARC File Format 1.1\r\n")

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        return self.name, self.written, self.records, self.size, self.sha.hexdigest()


def _tie() -> Column:
    """The first 60 bits of the digest, in its order."""
    return F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")


def revisits(digests: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat an earlier one's payload."""
    long = digests.where((F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    repeated = firsts.where("refers_to < last").drop("last")
    return long.join(repeated, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(
    pages: DataFrame,
    path: str,
    block_bytes: int = BLOCK_BYTES,
    roll_bytes: int = ROLL_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``path``, which must hold nothing; returns the manifest, one row per file."""
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        raise FileExistsError(f"{path} is not empty")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    n_bytes = F.octet_length("payload").cast("bigint").alias("n_bytes")
    digests = materialize(rows.select("page_id", "digest", _tie().alias("tie"), n_bytes), "digests")
    blocks = Blocks.of(digests, "page_id", "tie", F.col("n_bytes") + 512, block_bytes)
    known = revisits(digests, min_revisit_bytes).withColumns({"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")})
    columns = ["page_id", "digest", "refers_to", "url", "payload"]
    records = rows.withColumn("refers_to", F.lit(None).cast("bigint"))
    both = known.select(*columns).unionByName(records.select(*columns)).withColumn("tie", _tie())
    # of a page's rows those that say what it revisits come first
    order = ["page_id", F.col("payload").isNotNull(), "digest", "url"]
    dealt = blocks.deal(blocks.add(both, "page_id", "tie").select("block", *columns)).sortWithinPartitions(*order)

    def write(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        files = _Files(path, roll_bytes)
        done: list[tuple] = []
        page, refers, written = object(), {}, {}
        for batch in batches:
            for block, page_id, digest, target, url, data in zip(*(batch[c] for c in ("block", *columns))):
                if page_id != page or page_id is None:
                    page, refers, written = page_id, {}, {}
                if data is None:
                    refers[digest] = target
                    continue
                repeat = written.get(digest, 0)
                written[digest] = repeat + 1
                target = refers.get(digest)
                if target is None and repeat and len(data) >= min_revisit_bytes:
                    target = page_id
                url = None if url is None else url.decode()
                done += files.add(block, encode_record(page_id, url, data, digest.decode(), target, target is not None, repeat))
            if done:
                yield dict(zip(names, map(list, zip(*done))))
                done = []
        if files.out is not None:
            yield dict(zip(names, ([v] for v in files.close())))

    fields = [("file", pa.string()), ("written", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
    names = [name for name, _ in fields]
    store.create_dir(f"{root}/_temporary", recursive=True)
    manifest = materialize(arrow_rows(dealt, write, pa.schema(fields), _MANIFEST), "warc-manifest")

    def commit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, base = fs.FileSystem.from_uri(path)
        for frame in frames:
            for file, temporary in zip(frame["file"], frame["written"]):
                # a repeated attempt finds the file already in place
                if own.get_file_info(f"{base}/{temporary}").type != fs.FileType.NotFound:
                    own.move(f"{base}/{temporary}", f"{base}/{file}")
            yield frame

    committed = manifest.mapInPandas(commit, _MANIFEST)
    committed.drop("written").write.mode("overwrite").parquet(f"{path}/_manifest")
    store.delete_dir(f"{root}/_temporary")
    return pages.sparkSession.read.parquet(f"{path}/_manifest")


def members(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Contents of the gzip members of a file, one at a time; ``read`` gives its next bytes."""
    rest = read(READ_BYTES)
    while rest:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or read(READ_BYTES)
            if not rest:
                raise ValueError("the archive ends inside a record")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(parts)
        rest = rest or read(READ_BYTES)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, whose length and digest are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["warc-block-digest"]:
        raise ValueError(f"block digest differs in {headers['warc-record-id']}")
    return headers, block


class _Checked:
    """Reads a file and knows what it has read."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.size, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sha.update(data)
        return data


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a finished archive."""
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/_manifest/_SUCCESS").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} has no manifest: its writing was not finished")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest").drop("written")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archive under ``path``: page_id, url, record_type, payload_bytes, payload_digest, refers_to and,
    if asked for, payload (null for revisits). A missing, short, long or altered file raises ValueError."""
    fields = [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
    ]
    ddl = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    if with_payload:
        fields.append(("payload", pa.binary()))
        ddl += ", payload binary"
    schema = pa.schema(fields)

    def parse(records: Iterator[bytes]) -> Iterator[tuple]:
        for record in records:
            headers, block = parse_record(record)
            kind = headers["warc-type"]
            if kind == "warcinfo":
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            length = int(http.rpartition(b"Content-Length: ")[2])
            digest = headers["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (length, digest):
                raise ValueError(f"payload digest differs in {headers['warc-record-id']}")
            page, refers = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
            row = (page and int(page), headers.get("warc-target-uri"), kind, length, digest, refers and int(refers))
            yield (*row, payload if kind == "response" else None) if with_payload else row

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, n_records, n_bytes, sha in zip(*(batch[c] for c in ("file", "records", "bytes", "sha256"))):
                name = file.decode()
                if store.get_file_info(f"{root}/{name}").size != n_bytes:
                    raise ValueError(f"{name} is not the file of the manifest: its size differs")
                part, size, found = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    checked = _Checked(stream)
                    for row in parse(members(checked.read)):
                        part.append(row)
                        found += 1
                        size += row[3] if with_payload else 256
                        if size > 8 << 20:
                            yield dict(zip(schema.names, map(list, zip(*part))))
                            part, size = [], 0
                if (found, checked.size, checked.sha.hexdigest()) != (n_records, n_bytes, sha.decode()):
                    raise ValueError(f"{name} is not the file of the manifest")
                if part:
                    yield dict(zip(schema.names, map(list, zip(*part))))

    files = read_manifest(spark, path)
    tasks = max(1, min(MAX_READERS, files.count()))
    spread = files.repartition(tasks, F.xxhash64("file")) if tasks > 1 else files
    return arrow_rows(spread, run, schema, ddl)


def round_trip(pages: DataFrame) -> DataFrame:
    """Contract columns per page, read back from archives written to the shared folder."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages
), f as (
  select html, min(page_id) as first_page from p where n >= 100 group by html
)
select page_id, n as payload_bytes, sha256(p.html) as payload_digest,
  case when first_page <> page_id then 'revisit' else 'response' end as record_type,
  case when first_page <> page_id then first_page end as refers_to
from p left join f using (html)
"""
