"""Incremental ingest: new and changed documents to chunks and vectors in the tenant store.

The stream's checkpoint remembers which files were read; what a document was when it was last stored is kept beside the
chunks, in a log of keys (tenant, doc_id) with a hash of the content, the time of its file and the batch that stored it.
Every batch is compared with the log:

* a document whose content is stored already adds nothing, in whatever file it comes again;
* a changed document is chunked anew; its newest log line names the batch whose chunks count, so the older chunks are
  no longer read;
* a document whose file is older than what is stored came late and is left out.

Chunks are written before the log lines, so a batch that dies half-way is not seen; a batch run again writes the same
folders. Only the narrow log is read against a batch, and of it only the lines of the batch's documents are grouped.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.scalars import clean_text
from wardlake.operators.documents import chunk_documents
from wardlake.operators.retrieval import embed
from wardlake.operators.selection import first_per_group
from wardlake.session import materialize
from wardlake.sources import tenants

DOCUMENT_SCHEMA = "doc_id string, source string, title string, url string, text string"
DOCUMENT_COLUMNS = [part.split()[0] for part in DOCUMENT_SCHEMA.split(", ")]
KEY = ["tenant_id", "doc_id"]
LOG = "tenant_id string, doc_id string, content string, file_time timestamp, seq bigint"
# Files older than the newest one by more than this are still read.
MAX_FILE_AGE = "36500d"


def _log(spark: SparkSession, store: str) -> DataFrame:
    """Lines of finished batches; a fresh store has none."""
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{store}/keys")


def _newest(log: DataFrame) -> DataFrame:
    """Per document its last stored state."""
    last = F.max_by(F.struct("content", "file_time", "seq"), F.struct("seq", "file_time", "content"))
    return log.groupBy(*KEY).agg(last.alias("last")).select(*KEY, "last.*")


def changed_documents(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Documents of ``batch`` (with tenant_id, file_time) that are new, or newer than stored and different; of several
    versions in the batch the newest. Rows without doc_id can't be told from each other and are left out."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("source", "title", "url", "text")]
    content = F.sha2(F.concat_ws("\1", *said), 256)
    versions = batch.where("doc_id IS NOT NULL").withColumn("content", content)
    newest = first_per_group(versions, KEY, [F.desc("file_time"), F.desc("content")], 1).drop("rn")
    known = _newest(log.join(newest.select(*KEY), KEY, "left_semi"))
    known = known.select(*KEY, F.col("content").alias("old"), F.col("file_time").alias("old_time"))
    met = newest.join(known, KEY, "left")
    return met.where("old IS NULL OR (old <> content AND file_time >= old_time)").drop("old", "old_time")


def store_documents(batch: DataFrame, store: str, seq: int, encoder: PipelineModel) -> int:
    """Store batch number ``seq`` of documents; returns how many were new or changed."""
    spark = batch.sparkSession
    log = _log(spark, store) if _has_log(spark, store) else spark.createDataFrame([], LOG)
    placed = tenants.with_tenant(batch).select(*DOCUMENT_COLUMNS, "tenant_id", "file_time")
    earlier = log.where(F.col("seq") < seq)  # a batch that runs again finds what it found the first time
    changed = materialize(changed_documents(placed, earlier), "changed")
    n = changed.count()
    if n:
        cleaned = changed.withColumn("text", clean_text(F.col("text")))
        chunks = tenants.with_tenant(embed(chunk_documents(cleaned), encoder))
        tenants.append(chunks.withColumn("seq", F.lit(seq).cast("bigint")), f"{store}/chunks", f"batch-{seq}")
        lines = changed.select(*KEY, "content", "file_time", F.lit(seq).cast("bigint").alias("seq"))
        lines.write.mode("overwrite").parquet(f"{store}/keys/seq-{seq}")
    return n


def _has_log(spark: SparkSession, store: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/keys")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def live_chunks(spark: SparkSession, store: str, tenant_id: str | None = None) -> DataFrame:
    """Chunks of the last stored version of every document, of one tenant if named."""
    chunks = tenants.read_store(spark, f"{store}/chunks", tenant_id)
    log = _log(spark, store)
    if tenant_id is not None:
        log = log.where(F.col("tenant_id") == tenant_id)
    return chunks.join(_newest(log).select(*KEY, "seq"), [*KEY, "seq"], "left_semi")


def ingest_new_files(
    spark: SparkSession, incoming: str, store: str, checkpoint: str, encoder: PipelineModel, schema: str = DOCUMENT_SCHEMA
) -> None:
    """Process the files that arrived since the last run, then stop."""

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        store_documents(batch, store, batch_id, encoder)

    (
        spark.readStream.schema(schema)
        .option("maxFileAge", MAX_FILE_AGE)
        .parquet(incoming)
        .select("*", F.col("_metadata.file_modification_time").alias("file_time"))
        .writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
