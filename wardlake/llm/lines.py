"""Reversible line dedup: exact reference counts in sharded tables, cuckoo filters of the repeated lines before them.

A line's key is its 128-bit hash after stripping ASCII white space and lower-casing A-Z. The index keeps, as tables in
the shared folder, ``refs`` (key, doc_id), ``counts`` (key, number of documents, smallest doc_id) and one cuckoo filter
per key shard with the keys that more than one document holds. ``insert`` and ``delete`` write a new version of all
three: a key enters its filter when its count passes from one to two, and leaves it on the way back, so that deleting
documents restores exactly the state without them. Decisions probe the filters first; only keys that pass are looked
up in the exact counts.

A line held by many documents is a single pre-aggregated row in every shard, and the joins that attach decisions to
documents are plain equi-joins that adaptive execution splits.

Defined results: null and empty texts are one empty line; rows with the same doc_id are one document; rows without
doc_id are not counted and stay as they are; keys under ten code points are never dropped; an empty table gives an
empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardlake.llm.cuckoo import MAX_LOAD, CuckooFilter, Full
from wardlake.llm.joins import HOT_SHARE, hot_join
from wardlake.session import scratch_path

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY_CHARS = 10
MIN_SHARDS = 32
# Line keys that one shard should hold.
SHARD_KEYS = 500_000

KEY = ["k1", "k2"]
_FILTERS = "shard int, filter binary"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_tag(text: Column) -> Column:
    """Tells rows of the same doc_id with different texts apart."""
    return F.xxhash64(text)


def line_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, pos, k1, k2) of every line long enough to count."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    every = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), row_tag(F.col("text")).alias("tag"), F.posexplode(keys).alias("pos", "key")
    )
    k1, k2 = F.xxhash64("key"), F.xxhash64(F.lit("second"), F.col("key"))
    return every.where(F.length("key") >= MIN_KEY_CHARS).select("doc_id", "tag", "pos", k1.alias("k1"), k2.alias("k2"))


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@dataclass(frozen=True)
class LineIndex:
    """One version of the index: the folder of its tables and the number of key shards."""

    spark: SparkSession
    path: str
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, shards: int | None = None) -> LineIndex:
        """Index of ``docs``; ``path`` is a new folder (default: under the session's shared folder)."""
        spark = docs.sparkSession
        index = cls(spark, path or scratch_path(spark, "line-index"), shards or 0)
        index._write_refs(line_refs(docs).select("doc_id", *KEY).distinct())
        counts = _counted(index.refs())
        counts.write.parquet(f"{index.path}/counts")
        if not shards:
            index = cls(spark, index.path, max(MIN_SHARDS, -(-index.counts().count() // SHARD_KEYS)))
        index._write_filters(None, index.repeated().select(*KEY, F.lit(1).alias("change")))
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, shards: int) -> LineIndex:
        return cls(spark, path, shards)

    def refs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/refs")

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def repeated(self) -> DataFrame:
        return self.counts().where("n_docs >= 2")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTERS).parquet(f"{self.path}/filters")

    def insert(self, docs: DataFrame, path: str | None = None) -> LineIndex:
        """New version with ``docs`` added; documents already held are not counted twice."""
        after = LineIndex(self.spark, path or scratch_path(self.spark, "line-index"), self.shards)
        fresh = line_refs(docs).select("doc_id", *KEY).distinct().join(self.refs(), ["doc_id", *KEY], "left_anti")
        after._write_refs(fresh, self.refs())
        added = _counted(fresh)
        both = self.counts().unionByName(added).groupBy(*KEY)
        both.agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc")).write.parquet(f"{after.path}/counts")
        after._write_filters(self, self._changes(after))
        return after

    def delete(self, doc_ids: DataFrame, path: str | None = None) -> LineIndex:
        """New version without the documents of ``doc_ids`` (column doc_id)."""
        after = LineIndex(self.spark, path or scratch_path(self.spark, "line-index"), self.shards)
        gone = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        after._write_refs(self.refs().join(gone, "doc_id", "left_anti"))
        touched = self.refs().join(gone, "doc_id", "left_semi").select(*KEY).distinct()
        kept = self.counts().join(touched, KEY, "left_anti")
        again = _counted(after.refs().join(touched, KEY, "left_semi"))
        kept.unionByName(again).write.parquet(f"{after.path}/counts")
        after._write_filters(self, self._changes(after))
        return after

    def _write_refs(self, refs: DataFrame, old: DataFrame | None = None) -> None:
        (refs if old is None else old.unionByName(refs)).write.parquet(f"{self.path}/refs")

    def _changes(self, after: LineIndex) -> DataFrame:
        """Keys repeated before or after: change 1 (now repeated), -1 (no longer), 0 (as before)."""
        was = self.repeated().select(*KEY, F.lit(1).alias("was"))
        now = after.repeated().select(*KEY, F.lit(1).alias("now"))
        zero = F.lit(0)
        return was.join(now, KEY, "full").select(*KEY, (F.coalesce("now", zero) - F.coalesce("was", zero)).alias("change"))

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard")

    def _write_filters(self, before: LineIndex | None, changes: DataFrame) -> None:
        keyed = changes.select(self._shard(), "k1", "change").groupBy("shard")
        old = before.filters() if before else self.spark.createDataFrame([], _FILTERS)
        old.groupBy("shard").cogroup(keyed).applyInPandas(_updated, _FILTERS).write.parquet(f"{self.path}/filters")

    def maybe_repeated(self, keys: DataFrame) -> DataFrame:
        """Of distinct ``keys`` (k1, k2) those that pass their shard's filter."""
        keyed = keys.select(self._shard(), *KEY).groupBy("shard")
        return self.filters().groupBy("shard").cogroup(keyed).applyInPandas(_probed, "k1 bigint, k2 bigint")

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, tag, positions) of the lines to drop: repeated, and this is not the smallest document with them."""
        refs = line_refs(docs)
        passed = self.maybe_repeated(refs.select(*KEY).distinct())
        confirmed = self.repeated().join(passed, KEY, "left_semi").select(*KEY, "n_docs", "first_doc")
        total = self.counts().agg(F.sum("n_docs")).first()[0] or 0
        found = hot_join(refs, confirmed, KEY, F.col("n_docs") * HOT_SHARE >= total, ["first_doc"])
        hit = found.where(F.col("doc_id") != F.col("first_doc"))
        return hit.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("positions"))


def _updated(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    shard = int((old if len(old) else keys)["shard"].iloc[0])
    k1 = keys["k1"].to_numpy(dtype=np.int64).view(np.uint64)
    change = keys["change"].to_numpy(dtype=np.int64)
    live = int((change >= 0).sum())
    try:
        if not len(old):
            raise Full
        known = CuckooFilter.from_bytes(old["filter"].iloc[0])
        known.delete(k1[change < 0])
        if live > known.table.size * MAX_LOAD:
            raise Full
        known.insert(k1[change > 0])
    except Full:
        known = CuckooFilter.of(k1[change >= 0])
    return pd.DataFrame({"shard": [shard], "filter": [known.to_bytes()]})


def _probed(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    if not len(filters) or not len(keys):
        return pd.DataFrame({"k1": [], "k2": []}, dtype=np.int64)
    known = CuckooFilter.from_bytes(filters["filter"].iloc[0])
    hit = known.contains(keys["k1"].to_numpy(dtype=np.int64).view(np.uint64))
    return keys.loc[hit, ["k1", "k2"]]


@F.pandas_udf(StringType())
def _without(text: pd.Series, positions: pd.Series) -> pd.Series:
    out = []
    for t, drop in zip(text, positions):
        if t is not None and drop is not None:
            gone = {int(p) for p in drop}
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append(t)
    return pd.Series(out, dtype=object)


# so that a plan which uses the text in several places runs it once
_without = _without.asNondeterministic()


def deduplicated(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """Rows ``(row, text, n_lines, n_dropped)``: the row as it was, its text without the dropped lines, the counts.

    ``index`` defaults to one built from ``docs``.
    """
    index = index or LineIndex.build(docs)
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), row_tag(F.col("text")).alias("tag")
    )
    joined = rows.join(index.drops(docs), ["doc_id", "tag"], "left")
    text = F.col("row.text")
    # only texts that lose lines travel to Python
    losing = F.col("positions").isNotNull()
    kept = F.when(losing, _without(F.when(losing, text), F.col("positions"))).otherwise(text)
    return joined.select(
        "row",
        kept.alias("text"),
        F.size(lines_of(text)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """Contract columns per document: doc_id, n_lines, n_dropped, kept_sha256."""
    done = deduplicated(docs.select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("row.doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text`` and ``n_chars``, where present, counted anew.

    Documents of which nothing but white space is left go, as all they said is in others.
    """
    done = deduplicated(docs)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(WHITE)) == "")
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return done.where(~F.coalesce(emptied, F.lit(False))).select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


JUDGED_SQL = r"""
with l as (
  select doc_id, pos, line,
    translate(regexp_replace(regexp_replace(line, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))
), k as (
  select key, min(doc_id) as first_doc from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), m as (
  select l.*, k.key is not null and l.doc_id <> k.first_doc as dropped from l left join k using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from m group by doc_id
"""
