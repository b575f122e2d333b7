"""Registered queries: documents, questions, retrieval and their evaluation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from wardlake import clinical as C
from wardlake.clinical import with_ctes
from wardlake.functions.scalars import citation_label, clean_text, safe_id
from wardlake.functions.sql import sql_clean, sql_strip
from wardlake.operators import cells
from wardlake.operators import documents as docs
from wardlake.operators import questions as asks
from wardlake.operators import retrieval, retrieval_eval
from wardlake.plans.registry import query
from wardlake.session import materialize, scratch_path
from wardlake.sources import readers, tenants
from wardlake.streaming import ingest

TRUSTED = [f"src{i}" for i in range(15)]
# Shorter sentences say nothing about where a question comes from.
MIN_SENTENCE = 12
TRUSTED_IN = ", ".join(f"'{s}'" for s in TRUSTED)


SQL_CITATION = """CASE WHEN title IS NOT NULL AND title <> '' AND title <> 'None' THEN upper(source) || ': ' || title
    ELSE upper(source) || ' (doc ' || left(doc_id, 8) || ')' END"""


def sql_safe_id(expr):
    return f"coalesce(nullif(trim(regexp_replace(lower({sql_strip(expr)}), '[^a-z0-9_-]+', '_', 'g'), '_'), ''), 'unnamed')"


# --- corpus and chunks ----------------------------------------------------------------------------


@query("src_corpus", with_ctes("corpus", "SELECT * FROM corpus"))
def src_corpus(spark, d):
    return C.documents(spark, d)


@query("text_clean", with_ctes("corpus", f"SELECT doc_id, {sql_clean('text')} AS text FROM corpus"))
def text_clean(spark, d):
    return cleaned_of(spark, d).select("doc_id", "text")


@query(
    "corpus_filter",
    with_ctes(
        "corpus",
        f"""SELECT doc_id, source, length(t) AS n_chars FROM (SELECT *, {sql_clean('text')} AS t FROM corpus)
            WHERE source IN ({TRUSTED_IN}) AND length(t) BETWEEN 100 AND 40000""",
    ),
)
def corpus_filter(spark, d):
    kept = docs.corpus_filter(C.documents(spark, d), TRUSTED)
    return kept.select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"))


def cleaned_of(spark, d):
    return C.documents(spark, d).withColumn("text", clean_text(F.col("text")))


def chunks_of(spark, d):
    return docs.chunk_documents(cleaned_of(spark, d))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return docs.raw_pieces(cleaned_of(spark, d))


TURN_CHUNKS = f"""turn_chunks AS (SELECT * FROM (SELECT conv_id, turn,
    {sql_strip("coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 200) || ' ', '') || text")} AS chunk
    FROM conversations) WHERE length(chunk) >= 100)"""


def turn_chunks_of(spark, d):
    return docs.overlap_rows(C.table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query("chunk_overlap", f"WITH {TURN_CHUNKS} SELECT * FROM turn_chunks")
def chunk_overlap(spark, d):
    return turn_chunks_of(spark, d)


@query(
    "chunk_ids",
    f"""WITH {TURN_CHUNKS} SELECT conv_id, turn,
        concat(conv_id, '_', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS chunk_id FROM turn_chunks""",
)
def chunk_ids(spark, d):
    return docs.number_chunks(turn_chunks_of(spark, d), "conv_id", "turn").select("conv_id", "turn", "chunk_id")


@query("citation_label", with_ctes("corpus", f"SELECT doc_id, {SQL_CITATION} AS citation FROM corpus"))
def citations(spark, d):
    return C.documents(spark, d).select(
        "doc_id", citation_label(F.col("source"), F.col("title"), F.col("doc_id")).alias("citation")
    )


def _sql_page_text():
    text = "html"
    for pattern, by in docs.MARKUP:
        text = f"regexp_replace({text}, '{pattern}', {'chr(10)' if by == chr(10) else repr(by)}, 'g')"
    for entity, character in docs.ENTITIES:
        quoted = character.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return sql_clean(text)


@query(
    "page_extract",
    f"""SELECT page_id, doc_id, page, text FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS doc_id,
        row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) ORDER BY page_id) AS page,
        {_sql_page_text()} AS text FROM pages) WHERE length(text) >= 50""",
)
def page_extract(spark, d):
    return docs.extract_pages(C.table(spark, d, "pages"))


@query(
    "golden_passage",
    """SELECT conv_id, coalesce(nullif(left(concat_ws(' ', max(text) FILTER (turn = 1), max(text) FILTER (turn = 2),
        max(text) FILTER (turn = 3)), 1800), ''), left(max(text) FILTER (turn = 0), 1800)) AS passage
       FROM conversations WHERE turn <= 3 GROUP BY conv_id""",
)
def golden_passage(spark, d):
    return docs.golden_passages(C.table(spark, d, "conversations"), "conv_id", "turn", "text")


# --- stores and files -----------------------------------------------------------------------------


@query("jsonl_roundtrip", with_ctes("corpus", f"SELECT doc_id || '_0' AS chunk_id, doc_id, source, title, url, text, {SQL_CITATION} AS citation FROM corpus"))
def jsonl_roundtrip(spark, d):
    path = scratch_path(spark, "chunks")
    rows = C.documents(spark, d).select(
        F.concat("doc_id", F.lit("_0")).alias("chunk_id"), "doc_id", "source", "title", "url", "text",
        citation_label(F.col("source"), F.col("title"), F.col("doc_id")).alias("citation"),
    )
    readers.write_jsonl(rows, path)
    return readers.read_chunks(spark, path)


@query(
    "golden_explode",
    """SELECT item_id AS id, text AS question, concat(item_id, ',', item_id + 1) AS relevant_doc_ids,
       concat('topic ', item_id % 7) AS topic FROM benchmark""",
)
def golden_explode(spark, d):
    path = scratch_path(spark, "questions")
    question = F.struct(
        F.col("item_id").alias("id"),
        F.col("text").alias("question"),
        F.array(F.col("item_id").cast("string"), (F.col("item_id") + 1).cast("string")).alias("relevant_doc_ids"),
        F.concat(F.lit("topic "), F.col("item_id") % 7).alias("topic"),
    )
    # one set per block of 100 questions, so no line grows with the data
    sets = C.table(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 100).alias("block")).agg(
        F.collect_list(question).alias("questions")
    )
    readers.write_jsonl(sets.select(F.concat(F.lit("set "), "block").alias("description"), "questions"), path)
    return readers.read_questions(spark, path).withColumn("relevant_doc_ids", F.array_join("relevant_doc_ids", ","))


@query("index_append")
def index_append(spark, d):
    """Chunks with vectors per tenant after a base load and an upload that was written twice."""
    store = scratch_path(spark, "store")
    rows = C.documents(spark, d)
    encoder = retrieval.fit_encoder(rows)
    english = F.col("lang") == "en"

    def chunks(part):
        cleaned = part.withColumn("text", clean_text(F.col("text")))
        return tenants.with_tenant(retrieval.embed(docs.chunk_documents(cleaned), encoder))

    tenants.append(chunks(rows.where(english)), store, "base")
    upload = materialize(chunks(rows.where(~english)), "upload")
    for _ in range(2):  # the retry of a batch must not add rows
        tenants.append(upload, store, "upload-1")
    stored = tenants.read_store(spark, store)
    return stored.groupBy("tenant_id").agg(
        F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"),
        F.count_if(F.size("embedding") == retrieval.EMBED_DIM).alias("vectors"),
    )


SQL_TENANT_NAME = "concat(' ', c_mktsegment, ' / ', n_name, '! ')"


@query(
    "tenant_list",
    f"SELECT DISTINCT {sql_safe_id(SQL_TENANT_NAME)} AS tenant_id FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def tenant_list(spark, d):
    named = C.table(spark, d, "customer").join(C.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return tenants.tenant_list(named.select(safe_id(F.expr(SQL_TENANT_NAME)).alias("tenant_id")))


@query(
    "union_append",
    with_ctes("corpus", "SELECT doc_id, source, title FROM corpus UNION ALL SELECT concat('page-', page_id), 'web', url FROM pages"),
)
def union_append(spark, d):
    existing = C.documents(spark, d).select("doc_id", "source", "title")
    new = C.table(spark, d, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("doc_id"), F.col("url").alias("title"), F.lit("web").alias("source")
    )
    return existing.unionByName(new)


@query("ingest_incremental")
def ingest_incremental(spark, d):
    """Documents delivered in two parts, the first one again in a second file: per tenant what is stored in the end."""
    root = scratch_path(spark, "ingest")
    incoming, store, checkpoint = f"{root}/incoming", f"{root}/store", f"{root}/checkpoint"
    source = C.documents(spark, d)
    encoder = retrieval.fit_encoder(source)
    english = source.lang == "en"
    rows = source.select(*ingest.DOCUMENT_COLUMNS)
    first, rest = rows.where(english), rows.where(~english)
    first.write.mode("append").parquet(incoming)
    ingest.ingest_new_files(spark, incoming, store, checkpoint, encoder)
    rest.unionByName(first).write.mode("append").parquet(incoming)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_new_files(spark, incoming, store, checkpoint, encoder)
    return ingest.live_chunks(spark, store).groupBy("tenant_id").agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("ids")
    )


# --- questions and messages -----------------------------------------------------------------------

# wording appended to real messages, so that every rule has rows to find
MESSAGE_SQL = """concat(text, CASE (conv_id + turn) % 9 WHEN 0 THEN ' I have Chest Pain now' WHEN 1 THEN ' I cannot breathe'
    WHEN 2 THEN ' heartstroke mural' WHEN 3 THEN ' I want to die after a stroke' WHEN 4 THEN ' thoughts of self-harm' ELSE '' END)"""


def _sql_flag(expr):
    crisis = "|".join(asks.MENTAL_HEALTH_CRISIS).replace("'", "''")
    medical = "|".join(asks.MEDICAL_EMERGENCY).replace("'", "''")
    return (
        f"CASE WHEN regexp_matches({expr}, '(?i){crisis}') THEN 'mental_health_crisis' "
        f"WHEN regexp_matches({expr}, '(?i){medical}') THEN 'medical_emergency' ELSE 'none' END"
    )


@query("safety_flags", f"SELECT conv_id, turn, {_sql_flag(MESSAGE_SQL)} AS flag FROM conversations")
def safety_flags(spark, d):
    messages = C.table(spark, d, "conversations").withColumn("message", F.expr(MESSAGE_SQL))
    return messages.select("conv_id", "turn", F.coalesce(asks.safety_flag(F.col("message")), F.lit("none")).alias("flag"))


QUESTION_SQL = """concat(CASE (conv_id + turn) % 8 WHEN 0 THEN 'How many admissions in total? ' WHEN 1 THEN 'Forecast admissions count '
    WHEN 2 THEN 'What is the treatment guideline ' WHEN 3 THEN 'Explain the risk trend and plan the average ' WHEN 4 THEN 'next month risk '
    WHEN 5 THEN 'why predict the volume, should we? ' ELSE '' END, CASE WHEN (conv_id + turn) % 8 = 7 THEN '' ELSE text END)"""


def _sql_matched(words):
    return f"list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(q, w))"


SQL_ROUTE = f"""s AS (SELECT conv_id, turn, lower({QUESTION_SQL}) AS q,
        {_sql_matched(asks.ANALYTICS_WORDS)} AS a, {_sql_matched(asks.PREDICTION_WORDS)} AS p,
        {_sql_matched(asks.KNOWLEDGE_WORDS)} AS r, {_sql_matched(asks.FORECAST_VERBS)} AS v FROM conversations),
    t AS (SELECT *, greatest(len(a), len(p), len(r)) AS top, len(a) + len(p) + len(r) AS hits FROM s),
    w AS (SELECT *, CASE WHEN len(a) = top THEN 'analytics' WHEN len(p) = top THEN 'prediction' ELSE 'rag' END AS winner,
        CASE WHEN len(a) = top THEN a WHEN len(p) = top THEN p ELSE r END AS words FROM t),
    c AS (SELECT *, CASE WHEN {sql_strip('q')} = '' THEN 'empty question' WHEN len(v) > 0 AND winner <> 'prediction' THEN 'forecasting verb'
        WHEN top = 0 THEN 'no keyword' WHEN top / hits < CAST(0.34 AS DOUBLE) THEN 'low confidence' ELSE 'keywords' END AS reason FROM w)"""


@query(
    "route_questions",
    f"""WITH {SQL_ROUTE} SELECT conv_id, turn, reason,
        CASE reason WHEN 'forecasting verb' THEN 'prediction' WHEN 'keywords' THEN winner ELSE 'rag' END AS engine,
        CASE reason WHEN 'forecasting verb' THEN 1.0 WHEN 'keywords' THEN round_even(top / hits, 2)
             WHEN 'low confidence' THEN round_even(top / hits, 2) ELSE 0.0 END AS confidence,
        CASE reason WHEN 'forecasting verb' THEN array_to_string(v, ',') WHEN 'keywords' THEN array_to_string(words, ',')
             WHEN 'low confidence' THEN array_to_string(words, ',') ELSE '' END AS matched FROM c""",
)
def route_questions(spark, d):
    asked = C.table(spark, d, "conversations").select("conv_id", "turn", F.expr(QUESTION_SQL).alias("question"))
    return asks.route(asked).select(
        "conv_id", "turn", "reason", "engine", "confidence", F.array_join("matched", ",").alias("matched")
    )


@query(
    "flatten_content",
    f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN {sql_strip("text || chr(10) || 'noted'")}
        ELSE {sql_strip("'before' || chr(10) || text")} END AS message FROM conversations""",
)
def flatten_content(spark, d):
    def block(kind, text):
        return F.to_json(F.struct(F.lit(kind).alias("type"), text.alias("text")))

    text = F.col("text")
    blocks_1 = F.concat(F.lit("["), block("text", text), F.lit(","), block("tool_use", F.lit("ignored")), F.lit(',"noted"]'))
    blocks_2 = F.concat(F.lit('["before",'), block("text", F.lit("")), F.lit(","), block("text", text), F.lit("]"))
    content = F.when(F.col("turn") % 3 == 0, text).when(F.col("turn") % 3 == 1, blocks_1).otherwise(blocks_2)
    return C.table(spark, d, "conversations").select("conv_id", "turn", asks.flatten_content(content).alias("message"))


# --- vectors --------------------------------------------------------------------------------------


def vector_chunks(spark, d):
    """All vectors, beside the text they stand for where there is any; the cluster label plays the document."""
    vectors = C.table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("doc"), F.col("vec_id").alias("chunk_id"), "embedding", "label"
    )
    texts = C.documents(spark, d).select(F.col("doc_id").alias("doc"), "source", "title", "text")
    return vectors.join(texts, "doc", "left")


def vector_questions(spark, d):
    """One question per (label, source): the mean of its vectors."""
    mean = Summarizer.mean(F.col("v"))
    return (
        vector_chunks(spark, d)
        .select("label", "source", array_to_vector("embedding").alias("v"))
        .groupBy("label", "source")
        .agg(vector_to_array(mean).alias("embedding"))
        .select(F.concat_ws("-", "label", "source").alias("query_id"), "label", "source", "embedding")
    )


SQL_VECTORS = """vc AS (SELECT e.vec_id AS chunk_id, CAST(e.embedding AS DOUBLE[]) AS v, e.label, c.source, c.title, c.text, c.doc_id
        FROM embeddings e LEFT JOIN corpus c ON c.doc_id = CAST(e.vec_id AS VARCHAR)),
    dims AS (SELECT label, source, i, avg(x) AS m FROM (SELECT label, source, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vc)
        GROUP BY 1, 2, 3),
    questions AS (SELECT concat_ws('-', label, source) AS query_id, label, source, list(m ORDER BY i) AS q FROM dims GROUP BY label, source),
    retrieved AS (SELECT * FROM (SELECT query_id, chunk_id, questions.label AS qlabel, vc.label AS doc,
        row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(v, q), 9) DESC, chunk_id) AS rank
        FROM vc CROSS JOIN questions) WHERE rank <= 20),
    gold AS (SELECT query_id, label AS doc FROM questions UNION SELECT query_id, (label + 1) % 10 FROM questions)"""


def retrieved_of(spark, d, k=retrieval.CANDIDATES):
    vectors = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = retrieval.vector_topk(vectors, vector_questions(spark, d), k)
    return found.withColumnRenamed("item_id", "chunk_id").select("query_id", "chunk_id", "rank")


def ranked_docs(spark, d, k):
    labels = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"))
    return retrieved_of(spark, d, k).join(labels, "chunk_id")


def gold_of(spark, d):
    asked = vector_questions(spark, d).select("query_id", "label")
    return asked.select("query_id", F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10)).alias("doc_id"))


def vcheck(body):
    return with_ctes("corpus", f"WITH {SQL_VECTORS}{body}")


@query("vector_topk", vcheck(" SELECT query_id, chunk_id, rank FROM retrieved"))
def vector_topk(spark, d):
    return retrieved_of(spark, d).select("query_id", "chunk_id", F.col("rank").cast("bigint"))


@query(
    "tenant_search",
    vcheck(
        """ SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id,
            row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(v, q), 9) DESC, chunk_id) AS rank
            FROM vc JOIN questions ON vc.source = questions.source) WHERE rank <= 5"""
    ),
)
def tenant_search(spark, d):
    store = scratch_path(spark, "cells")
    cells.write_cells(vector_chunks(spark, d).select("source", "chunk_id", "embedding"), store, "source")
    found = cells.search_cells(spark, store, vector_questions(spark, d), 5, "source").found
    return found.select("query_id", F.col("item_id").alias("chunk_id"), F.col("rank").cast("bigint"))


@query(
    "relevance_join",
    vcheck(
        """ SELECT r.query_id, r.chunk_id, r.rank, (g.query_id IS NOT NULL)::INT AS relevant FROM retrieved r
            LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc = r.doc"""
    ),
)
def relevance_join(spark, d):
    marked = retrieval_eval.mark_relevant(ranked_docs(spark, d, 20), gold_of(spark, d))
    return marked.select("query_id", "chunk_id", F.col("rank").cast("bigint"), "relevant")


def sql_metrics(k, name):
    gains = ", ".join(f"{w!r}::DOUBLE" for w in retrieval_eval.ideal(k))
    flags = ", ".join(f"coalesce(max(rel) FILTER (rank = {i}), 0) AS r{i}" for i in range(1, k + 1))
    total = " + ".join(f"r{i}" for i in range(1, k + 1))
    gain = " + ".join(f"r{i} * {w!r}::DOUBLE" for i, w in enumerate(retrieval_eval.discount(k), 1))
    return f"""{name} AS (SELECT query_id, (({total}) > 0)::INT AS hit, coalesce(1.0::DOUBLE / first, 0.0) AS mrr,
        CASE WHEN ({total}) > 0 THEN ({gain}) / [{gains}][({total}) + 1] ELSE 0.0 END AS ndcg,
        CAST(r1 AS DOUBLE) AS p_at_1, (r1 + r2 + r3) / 3.0::DOUBLE AS p_at_3, ({total}) / {float(k)}::DOUBLE AS p_at_k,
        docs / CAST(gold_docs AS DOUBLE) AS recall
        FROM (SELECT m.query_id, {flags}, min(rank) FILTER (rel = 1) AS first, count(DISTINCT doc) FILTER (rel = 1) AS docs
            FROM (SELECT r.*, (g.query_id IS NOT NULL)::INT AS rel FROM retrieved r
                LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc = r.doc WHERE rank <= {k}) m GROUP BY 1)
        JOIN (SELECT query_id, count(*) AS gold_docs FROM gold GROUP BY 1) USING (query_id))"""


SQL_MEANS = ", ".join(
    f"CAST(sum(CAST(CAST({m} AS DOUBLE) AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS {m}" for m in retrieval_eval.METRICS
)
SQL_GRID_MEANS = ", ".join(
    f"CAST(sum(CAST(CAST({m} AS DOUBLE) AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS {m}"
    for m in ("hit", "mrr", "ndcg", "p_at_1", "p_at_k", "recall")
)


def metrics_of(spark, d):
    return retrieval_eval.retrieval_metrics(ranked_docs(spark, d, 20), gold_of(spark, d))


@query("retrieval_metrics", vcheck(f", {sql_metrics(5, 'm')} SELECT * FROM m"))
def retrieval_metrics(spark, d):
    return metrics_of(spark, d)


@query("retrieval_summary", vcheck(f", {sql_metrics(5, 'm')} SELECT count(*) AS n, {SQL_MEANS} FROM m"))
def retrieval_summary(spark, d):
    return retrieval_eval.retrieval_summary(metrics_of(spark, d))


@query("results_csv", vcheck(f", {sql_metrics(5, 'm')} SELECT query_id, hit, mrr, ndcg, recall FROM m"))
def results_csv(spark, d):
    path = scratch_path(spark, "results")
    readers.write_csv(metrics_of(spark, d), path)
    back = readers.read_csv_table(spark, path, ["query_id", *retrieval_eval.METRICS])
    return back.select("query_id", F.col("hit").cast("int"), *[F.col(c).cast("double") for c in ("mrr", "ndcg", "recall")])


@query(
    "retrieval_grid",
    vcheck(
        ", "
        + ", ".join(sql_metrics(k, f"m{k}") for k in retrieval_eval.GRID)
        + " "
        + " UNION ALL ".join(
            f"SELECT {k}::BIGINT AS k, 'OFF' AS rerank, {SQL_GRID_MEANS} FROM m{k}" for k in retrieval_eval.GRID
        )
    ),
)
def retrieval_grid(spark, d):
    ranked = materialize(ranked_docs(spark, d, 20), "ranked")
    return retrieval_eval.retrieval_grid(ranked, materialize(gold_of(spark, d), "gold"), "OFF")


def passages_of(spark, d, k=5):
    texts = vector_chunks(spark, d).select(
        "chunk_id", citation_label(F.col("source"), F.col("title"), F.col("doc")).alias("citation"), "text"
    )
    return retrieved_of(spark, d).where(F.col("rank") <= k).join(texts, "chunk_id")


# a vector without a text has no source, and its own number stands for the document
SQL_VCITATION = SQL_CITATION.replace("upper(source)", "upper(coalesce(source, 'unknown'))").replace("doc_id", "CAST(chunk_id AS VARCHAR)")


@query(
    "context_block",
    vcheck(
        f""" SELECT query_id, string_agg('[' || rank || '] (source: ' || coalesce(citation, '') || ')' || chr(10)
                || coalesce({sql_strip('left(text, 1500)')}, ''),
            chr(10) || chr(10) ORDER BY rank) AS context
            FROM retrieved JOIN (SELECT chunk_id, {SQL_VCITATION} AS citation, text FROM vc) USING (chunk_id)
            WHERE rank <= 5 GROUP BY query_id"""
    ),
)
def context_block(spark, d):
    return retrieval.context_block(passages_of(spark, d))


@query(
    "dedup_sources",
    vcheck(
        """ SELECT query_id, upper(source) AS citation, min(rank) AS first_rank FROM retrieved JOIN vc USING (chunk_id) GROUP BY 1, 2"""
    ),
)
def dedup_sources(spark, d):
    cited = retrieved_of(spark, d).join(
        vector_chunks(spark, d).select("chunk_id", F.upper("source").alias("citation")), "chunk_id"
    )
    return retrieval.dedup_sources(cited.withColumn("rank", F.col("rank").cast("bigint")))


@query(
    "index_alignment",
    """SELECT count(c) AS chunks, count(v) AS vectors, count(*) FILTER (v IS NULL) AS without_vector,
       count(*) FILTER (c IS NULL) AS without_chunk FROM (SELECT doc_id AS k, 1 AS c FROM documents) a
       FULL JOIN (SELECT vec_id AS k, 1 AS v FROM embeddings) b USING (k)""",
)
def index_alignment(spark, d):
    return retrieval.index_alignment(C.table(spark, d, "documents"), C.table(spark, d, "embeddings"), "doc_id", "vec_id")


# --- text search ----------------------------------------------------------------------------------


@query("embed_text")
def embed_text(spark, d):
    chunks = materialize(chunks_of(spark, d), "chunks")
    coded = retrieval.embed(chunks, retrieval.fit_encoder(chunks))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return coded.select("chunk_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"), "embedding")


def text_search(spark, d):
    """Candidates and re-ranked results of the question table over all document chunks."""
    chunks = materialize(chunks_of(spark, d), "chunks")
    encoder = retrieval.fit_encoder(chunks)
    asked = C.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    coded = retrieval.embed(asked, encoder_for(encoder, "query_text"))
    found = materialize(retrieval.vector_topk(retrieval.embed(chunks, encoder), coded, retrieval.CANDIDATES), "candidates")
    texts = chunks.select(F.col("chunk_id").alias("item_id"), "text")
    best = retrieval.rerank(found, asked, texts, max(retrieval_eval.GRID))
    owner = chunks.select(F.col("chunk_id").alias("item_id"), "doc_id")
    return found.join(owner, "item_id"), best.join(owner, "item_id")


def question_gold(spark, d):
    """Documents that hold any sentence of a question, found by an equi-join on sentences.

    A question without such a document keeps a row with a NULL document, so it counts as a miss.
    """

    def sentences(text):
        every = F.transform(F.split(clean_text(text), r"[.\n]+"), lambda s: F.btrim(s))
        return F.explode(F.array_distinct(F.filter(every, lambda s: F.length(s) >= MIN_SENTENCE))).alias("sentence")

    questions = C.table(spark, d, "benchmark")
    asked = questions.select(F.col("item_id").alias("query_id"), sentences(F.col("text")))
    held = C.documents(spark, d).select("doc_id", sentences(F.col("text")))
    found = held.join(asked, "sentence").select("query_id", "doc_id").distinct()
    return materialize(questions.select(F.col("item_id").alias("query_id")).join(found, "query_id", "left"), "gold")


def encoder_for(encoder, column):
    """The fitted encoder reading another text column."""
    from pyspark.ml import PipelineModel

    tokens = encoder.stages[0].copy({encoder.stages[0].inputCol: column})
    return PipelineModel([tokens, *encoder.stages[1:]])


@query("rerank_topk")
def rerank_topk(spark, d):
    _, best = text_search(spark, d)
    return best.where(F.col("rank") <= retrieval.KEPT).select("query_id", "item_id", "doc_id", "rerank_score", "rank")


@query("retrieval_grid_rerank")
def retrieval_grid_rerank(spark, d):
    before, after = text_search(spark, d)
    after, gold = materialize(after, "reranked"), question_gold(spark, d)
    return retrieval_eval.retrieval_grid(after, gold, "ON").unionByName(retrieval_eval.retrieval_grid(before, gold, "OFF"))


@query("rerank_lift")
def rerank_lift(spark, d):
    before, after = text_search(spark, d)
    gold = question_gold(spark, d)
    kept = F.col("rank") <= retrieval_eval.K
    return retrieval_eval.rerank_lift(before.where(kept), after.where(kept), gold)


# --- answers and tool calls -----------------------------------------------------------------------


@query(
    "answer_checks",
    """SELECT topic, count(*) AS n, count(answer) AS answered, count(*) - count(answer) AS failed,
        coalesce(CAST(sum(latency) FILTER (answer IS NOT NULL) AS DOUBLE) / nullif(count(answer), 0), 0.0) AS avg_latency,
        coalesce(CAST(max(latency) FILTER (answer IS NOT NULL) AS DOUBLE), 0.0) AS max_latency,
        coalesce(count(*) FILTER (regexp_matches(answer, '\\[\\d+\\]')) / nullif(count(answer), 0), 0.0) AS citation_rate
       FROM (SELECT turn AS topic, CASE WHEN (conv_id + turn) % 13 = 0 THEN NULL WHEN (conv_id + turn) % 3 = 0 THEN concat(text, ' [1]')
                ELSE text END AS answer, CAST(length(text) AS DECIMAL(28,6)) AS latency FROM conversations WHERE role = 'assistant')
       GROUP BY 1""",
)
def answer_checks(spark, d):
    turns = C.table(spark, d, "conversations").where(F.col("role") == "assistant")
    mark = F.col("conv_id") + F.col("turn")
    answer = F.when(mark % 13 == 0, None).when(mark % 3 == 0, F.concat("text", F.lit(" [1]"))).otherwise(F.col("text"))
    answers = turns.select(F.col("turn").alias("topic"), answer.alias("answer"), F.length("text").alias("latency"))
    return retrieval_eval.answer_checks(answers, ["topic"])


_TOOL_SQL = "CASE l_linenumber WHEN 1 THEN 'search_guidelines' WHEN 2 THEN 'get_hospital_kpis' WHEN 3 THEN 'forecast_admissions' WHEN 4 THEN 'get_doctor_stats' ELSE 'unknown_tool' END"


def tool_log(spark, d):
    """One logged question per order: lines flagged R or A were expected, lines with status F were called.

    Sets of at most five tool names, however many lines an order has.
    """
    tool = F.expr(_TOOL_SQL)
    lines = C.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_returnflag") != "N", tool)).alias("expected"),
        F.collect_set(F.when(F.col("l_linestatus") == "F", tool)).alias("called"),
        F.max((F.col("l_linestatus") == "F").cast("int")).alias("completed"),
        F.count("*").alias("steps"),
    )
    return lines.withColumnRenamed("l_orderkey", "question_id")


SQL_LOG = f"""log AS (SELECT l_orderkey AS question_id, coalesce(list(DISTINCT {_TOOL_SQL}) FILTER (l_returnflag <> 'N'), []) AS expected,
    coalesce(list(DISTINCT {_TOOL_SQL}) FILTER (l_linestatus = 'F'), []) AS called, max((l_linestatus = 'F')::INT) AS completed, count(*) AS steps
    FROM lineitem GROUP BY 1),
  marked AS (SELECT *, len(list_intersect(list_distinct(expected), list_distinct(called))) AS overlap,
    list_has_all(called, expected) AS is_subset,
    list_has_all(called, expected) AND list_has_all(expected, called) AS is_equal FROM log)"""


@query(
    "set_overlap",
    f"WITH {SQL_LOG} SELECT question_id, CAST(overlap AS BIGINT) AS overlap, is_subset, is_equal FROM marked",
)
def set_overlap(spark, d):
    marked = retrieval_eval.set_overlap(tool_log(spark, d), "expected", "called")
    return marked.select("question_id", F.col("overlap").cast("bigint"), "is_subset", "is_equal")


@query(
    "tool_call_scores",
    f"""WITH {SQL_LOG} SELECT steps AS size_class, count(*) AS n, CAST(sum(is_equal::INT) AS DOUBLE) / count(*) AS exact_accuracy,
        CAST(sum(CASE WHEN len(expected) > 0 AND is_subset THEN 1 ELSE is_equal::INT END) AS DOUBLE) / count(*) AS partial_accuracy,
        CAST(sum(completed) AS DOUBLE) / count(*) AS completion_rate,
        CAST(sum(len(list_filter(called, lambda t: t = 'unknown_tool'))) AS BIGINT) AS invalid_calls,
        CAST(sum(steps) AS DOUBLE) / count(*) AS avg_steps FROM marked GROUP BY 1""",
)
def tool_call_scores(spark, d):
    log = tool_log(spark, d).withColumn("size_class", F.col("steps"))
    return retrieval_eval.tool_call_scores(log, ["size_class"])


# --- whole ways from raw input to chunks -----------------------------------------------------------


@query(
    "oversized_documents",
    with_ctes(
        "corpus",
        f"""SELECT source, count(*) FILTER (length({sql_clean('text')}) > 40000) AS oversized FROM corpus
            WHERE source IN ({TRUSTED_IN}) GROUP BY source""",
    ),
)
def oversized_documents(spark, d):
    return docs.oversized(C.documents(spark, d), TRUSTED)


@query(
    "corpus_build",
    with_ctes(
        "corpus",
        f"""SELECT doc_id, source, {SQL_CITATION} AS citation FROM (SELECT *, row_number() OVER (PARTITION BY source
                ORDER BY CAST(doc_id AS BIGINT)) AS rn FROM (SELECT *, {sql_clean('text')} AS t FROM corpus)
            WHERE source IN ({TRUSTED_IN}) AND length(t) BETWEEN 100 AND 40000) WHERE rn <= 200""",
    ),
)
def corpus_build(spark, d):
    """Every document that the build keeps, seen through its chunks."""
    built = docs.corpus_build(C.documents(spark, d), TRUSTED, [F.col("doc_id").cast("bigint")])
    return built.select("doc_id", "source", "citation").distinct()


@query(
    "page_ingest",
    f"""SELECT doc_id, page, concat('web: ', doc_id, ' (p.', page, ')') AS citation FROM (SELECT page_id,
        regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS doc_id, row_number() OVER (PARTITION BY
        regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) ORDER BY page_id) AS page, {_sql_page_text()} AS text FROM pages)
        WHERE length(text) >= 100""",
)
def page_ingest(spark, d):
    """Extracted pages stored as chunks with page citations, seen page by page."""
    store = scratch_path(spark, "page-store")
    chunks = docs.page_chunks(docs.extract_pages(C.table(spark, d, "pages")), "web")
    tenants.append(chunks, store, "pages")
    stored = tenants.read_store(spark, store, "web")
    return stored.select("doc_id", F.col("page").cast("bigint"), "citation").distinct()
