"""Document cleaning, selection, chunking, page extraction and passages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.chunks import CHUNK_OVERLAP, MIN_CHUNK, chunk_texts, split_pieces
from wardlake.functions.scalars import citation_label, clean_text, safe_id, strip
from wardlake.operators.selection import first_per_group
from wardlake.scale import row_numbers

# Length limits of a document and a page, and the per-source cap.
MIN_DOC_CHARS = 100
MAX_DOC_CHARS = 40_000
MIN_PAGE_CHARS = 50
DOCS_PER_SOURCE = 200
PASSAGE_CHARS = 1_800


def corpus_filter(documents: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Cleaned documents of trusted sources with a usable length."""
    return usable(documents.where(F.col("source").isin(list(sources))))


def usable(documents: DataFrame) -> DataFrame:
    """Cleaned documents whose length is within the limits."""
    cleaned = documents.withColumn("text", clean_text(F.col("text")))
    return cleaned.where(F.length("text").between(MIN_DOC_CHARS, MAX_DOC_CHARS))


def oversized(documents: DataFrame, sources: Sequence[str]) -> DataFrame:
    """How many trusted documents are too long, per source."""
    trusted = documents.where(F.col("source").isin(list(sources)))
    too_long = F.length(clean_text(F.col("text"))) > MAX_DOC_CHARS
    return trusted.groupBy("source").agg(F.count_if(too_long).alias("oversized"))


def balanced_cap(
    documents: DataFrame, order: Sequence[Column], per_source: int = DOCS_PER_SOURCE, rank: str = "position"
) -> DataFrame:
    """At most ``per_source`` documents of each source, the first in ``order``."""
    return first_per_group(documents, ["source"], order, per_source, rank=rank)


def corpus_build(documents: DataFrame, sources: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The whole way from raw documents to chunk rows: trusted, cleaned, sized, capped per source, chunked, numbered."""
    return chunk_documents(balanced_cap(corpus_filter(documents, sources), order))


def chunk_documents(documents: DataFrame) -> DataFrame:
    """One row per chunk, numbered after short ones are dropped. Stays inside the document's row: no shuffle.

    The chunker is exploded directly; through a named column Spark would run it a second time to
    filter out documents without chunks.
    """
    exploded = documents.select(
        "doc_id", "source", "title", "url", F.posexplode(chunk_texts("text")).alias("position", "text")
    )
    return exploded.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), "position").alias("chunk_id"),
        "doc_id",
        "source",
        "title",
        "url",
        "text",
        citation_label(F.col("source"), F.col("title"), F.col("doc_id").cast("string")).alias("citation"),
    )


def raw_pieces(documents: DataFrame) -> DataFrame:
    """Pieces before overlap: ``(doc_id, position, piece)``."""
    return documents.select("doc_id", F.posexplode(split_pieces("text")).alias("position", "piece"))


def overlap_rows(pieces: DataFrame, doc: str, position: str, text: str) -> DataFrame:
    """The overlap for pieces already stored as rows. Neighbours meet by an equi-join on

    (document, position), so a document with very many pieces is spread over tasks.
    """
    tail = pieces.select(
        F.col(doc), (F.col(position) + 1).alias(position), F.right(F.col(text), F.lit(CHUNK_OVERLAP)).alias("__tail")
    )
    joined = pieces.join(tail, [doc, position], "left")
    full = strip(F.concat(F.coalesce(F.concat("__tail", F.lit(" ")), F.lit("")), F.col(text)))
    return joined.select(doc, position, full.alias("chunk")).where(F.length("chunk") >= MIN_CHUNK)


def number_chunks(chunks: DataFrame, doc: str, position: str, block: int = 1_000) -> DataFrame:
    """``doc_i`` ids for kept chunks, numbered in order without gaps."""
    numbered = row_numbers(chunks, [doc], F.floor(F.col(position) / block), [F.col(position)], "__rn")
    return numbered.withColumn("chunk_id", F.concat_ws("_", F.col(doc).cast("string"), F.col("__rn") - 1)).drop("__rn")


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))


# --- pages ---------------------------------------------------------------------------------------

# Markup removed from a page, in order, and the entities turned back into characters.
MARKUP = [
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?is)<!--.*?-->", " "),
    (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n"),
    (r"<[^>]+>", " "),
]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_text(html: Column) -> Column:
    text = html
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return clean_text(text)


def page_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def extract_pages(pages: DataFrame, block: int = 1_000) -> DataFrame:
    """Cleaned page texts numbered inside their site; near-empty pages are skipped but keep their number."""
    located = pages.select("page_id", page_host(F.col("url")).alias("doc_id"), "html")
    numbers = row_numbers(
        located.select("page_id", "doc_id"), ["doc_id"], F.floor(F.col("page_id") / block), [F.col("page_id")], "page"
    )
    texts = located.select("page_id", html_text(F.col("html")).alias("text")).where(F.length("text") >= MIN_PAGE_CHARS)
    return numbers.join(texts, "page_id").select("page_id", "doc_id", "page", "text")


def page_chunks(pages: DataFrame, tenant: str) -> DataFrame:
    """Chunk rows of extracted pages for one tenant, with page citations."""
    exploded = pages.select("doc_id", "page", F.posexplode(chunk_texts("text")).alias("position", "text"))
    return exploded.select(
        safe_id(F.lit(tenant)).alias("tenant_id"),
        F.concat(F.col("doc_id"), F.lit("_p"), F.col("page"), F.lit("_"), F.col("position")).alias("chunk_id"),
        "doc_id",
        F.lit(tenant).alias("source"),
        F.col("doc_id").alias("title"),
        F.lit("uploaded").alias("url"),
        "page",
        "text",
        F.concat(F.lit(f"{tenant}: "), F.col("doc_id"), F.lit(" (p."), F.col("page"), F.lit(")")).alias("citation"),
    )


def golden_passages(chunks: DataFrame, doc: str, position: str, text: str) -> DataFrame:
    """Per document: chunks 1-3 joined and cut, else chunk 0. At most four rows per document are gathered."""
    at = {i: F.max(F.when(F.col(position) == i, F.col(text))) for i in range(4)}
    body = F.left(F.concat_ws(" ", at[1], at[2], at[3]), F.lit(PASSAGE_CHARS))
    return (
        chunks.where(F.col(position) <= 3)
        .groupBy(doc)
        .agg(F.coalesce(F.nullif(body, F.lit("")), F.left(at[0], F.lit(PASSAGE_CHARS))).alias("passage"))
    )
