import datetime as dt
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlake.functions.chunks import chunk_text, split_text
from wardlake.operators import documents as docs
from wardlake.operators import questions as asks
from wardlake.operators import retrieval, retrieval_eval
from wardlake.sources import tenants
from wardlake.streaming import ingest


# --- chunks


def squeeze(text):
    return re.sub(r"[\s.]+", "", text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", ". ", "\n", "\n\n", " ", "x" * 30, "é"]), max_size=120).map("".join))
def test_pieces_fit_and_lose_only_separators(text):
    pieces = split_text(text, size=25)
    assert all(len(p) <= 25 for p in pieces)
    assert squeeze("".join(pieces)) == squeeze(text)


def test_split_edges():
    assert split_text("x" * 2000) == ["x" * 2000]
    assert [len(p) for p in split_text("y" * 5000)] == [2000, 2000, 1000]
    assert split_text("a b\n\nc d", size=5) == ["a b", "c d"]
    assert split_text("aa bb cc\n\ndd", size=5) == ["aa bb", "cc", "dd"]
    assert split_text("one. two. three", size=9) == ["one. two", "three"]
    assert chunk_text("") == []
    assert chunk_text("z" * 99) == [] and chunk_text("z" * 100) == ["z" * 100]


def test_overlap_rule():
    first, second = "a" * 1990 + " end", "b" * 1500
    chunks = chunk_text(first + "\n\n" + second)
    assert chunks[0] == first
    assert chunks[1] == first[-200:] + " " + second


def test_chunk_documents(spark):
    rows = [("d1", "who", "T", "u", "p" * 1990 + "\n\n" + "q" * 500), ("d2", "cdc", None, "u", "short"), ("d3", "nice", "None", "u", None)]
    df = spark.createDataFrame(rows, "doc_id string, source string, title string, url string, text string")
    got = docs.chunk_documents(df).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == ["d1_0", "d1_1"]
    assert got[0]["citation"] == "WHO: T"
    plan = docs.chunk_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and "Exchange" not in plan


def test_overlap_rows_and_numbering(spark):
    rows = [("d", i, t) for i, t in enumerate(["a" * 300, "b" * 20, "c" * 150, " "])] + [("e", 0, "tiny")]
    pieces = spark.createDataFrame(rows, "doc string, pos int, text string")
    chunks = docs.overlap_rows(pieces, "doc", "pos", "text")
    got = {r["pos"]: r["chunk"] for r in chunks.collect()}
    assert got == {0: "a" * 300, 1: "a" * 200 + " " + "b" * 20, 2: "b" * 20 + " " + "c" * 150, 3: "c" * 150}
    dropped = chunks.where(F.col("pos") != 1)
    ids = docs.number_chunks(dropped, "doc", "pos", block=2).orderBy("pos").collect()
    assert [r["chunk_id"] for r in ids] == ["d_0", "d_1", "d_2"]


def test_golden_passage(spark):
    rows = [("a", i, f"t{i}") for i in range(6)] + [("b", 0, "only" * 600)]
    got = {r["d"]: r["passage"] for r in docs.golden_passages(spark.createDataFrame(rows, "d string, i int, t string"), "d", "i", "t").collect()}
    assert got["a"] == "t1 t2 t3" and got["b"] == ("only" * 600)[:1800]


def test_pages(spark):
    body = "Fever &amp; cough <b>plan</b> for all patients in the ward, twice a day"
    html = f"<html><style>x</style><script>var a='</p>';</script><p>{body}</p><!-- no --></html>"
    rows = [(1, "http://h.example/a", html), (2, "http://h.example/b", "<p>short</p>"), (3, "http://h.example/c?x", html)]
    got = docs.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r["page_id"], r["page"], r["doc_id"]) for r in got] == [(1, 1, "h.example"), (3, 3, "h.example")]
    assert got[0]["text"] == "Fever & cough plan for all patients in the ward, twice a day"


# --- questions


def routed(spark, *questions):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, question string")
    return asks.route(df).orderBy("i").collect()


def test_routing(spark):
    got = routed(
        spark,
        "how many admissions did we have",
        "forecast admissions for next 6 months",
        "what is the treatment guideline for sepsis",
        "",
        None,
        "hello there",
        "Explain the risk trend",
        "count the total average and project the volume",
    )
    assert [r["engine"] for r in got] == ["analytics", "prediction", "rag", "rag", "rag", "rag", "rag", "prediction"]
    assert got[3]["confidence"] == 0.0 and got[4]["confidence"] == 0.0
    assert got[1]["confidence"] == 1.0 or got[1]["reason"] == "forecasting verb"
    assert got[6]["reason"] == "low confidence" and got[6]["confidence"] == pytest.approx(0.33)
    assert got[7]["matched"] == ["project"]


def test_safety(spark):
    cases = {
        "I have CHEST PAIN": "medical_emergency",
        "I can't breathe": "medical_emergency",
        "i cant breathe": "medical_emergency",
        "I can not breathe": "medical_emergency",
        "heatstroke advice": None,
        "a stroke, and I want to die": "mental_health_crisis",
        "self harm": "mental_health_crisis",
        "bleeding heavily": "medical_emergency",
        "": None,
    }
    df = spark.createDataFrame(list(cases.items()), "q string, want string")
    for r in df.withColumn("got", asks.safety_flag(F.col("q"))).collect():
        assert r["got"] == r["want"], r["q"]


def test_flatten(spark):
    cases = [
        ("plain [1] text", "plain [1] text"),
        ('[{"type":"text","text":"a"},{"type":"tool"},"b",{"type":"text","text":""}]', "a\nb"),
        ("[not json", "[not json"),
        ("[]", ""),
    ]
    df = spark.createDataFrame(cases, "c string, want string")
    for r in df.withColumn("got", asks.flatten_content(F.col("c"))).collect():
        assert r["got"] == r["want"]


# --- retrieval


def vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[20:40] = data[0]  # many exact copies: ties
    rows = [(i, "t%d" % (i % 3), [float(x) for x in data[i]]) for i in range(n)]
    return data, spark.createDataFrame(rows, "chunk_id long, tenant_id string, embedding array<float>").repartition(5)


def brute_topk(data, queries, k, allowed=None):
    out = set()
    for q in range(len(queries)):
        scores = np.round(data.astype(np.float64) @ queries[q].astype(np.float64), 9)
        order = sorted((i for i in range(len(data)) if allowed is None or allowed(i, q)), key=lambda i: (-scores[i], i))
        out |= {(q, i, rank) for rank, i in enumerate(order[:k], 1)}
    return out


@pytest.mark.parametrize("limit", [4096, 5])
def test_topk_broadcast_and_blocks(spark, limit):
    data, chunks = vectors(spark)
    queries = data[:12]
    asked = spark.createDataFrame([(i, "t%d" % (i % 3), [float(x) for x in q]) for i, q in enumerate(queries)], "query_id long, tenant_id string, embedding array<float>")
    found = retrieval.vector_topk(chunks, asked, 7, max_broadcast=limit).collect()
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in found} == brute_topk(data, queries, 7)
    own = retrieval.vector_topk(chunks, asked, 200, tenant="tenant_id", max_broadcast=limit).collect()
    want = brute_topk(data, queries, 200, lambda i, q: i % 3 == q % 3)
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in own} == want


def test_topk_fewer_rows_than_k_and_no_queries(spark):
    _, chunks = vectors(spark, 50)
    few = chunks.where("chunk_id in (45, 46)")
    asked = chunks.where("chunk_id = 3").withColumnRenamed("chunk_id", "query_id")
    assert retrieval.vector_topk(few, asked, 20).count() == 2
    assert retrieval.vector_topk(few, asked.where("false"), 20).count() == 0


def test_embed_and_rerank(spark):
    texts = [("c1", "sepsis treatment with fluids and antibiotics"), ("c2", "the hospital menu of the week"), ("c3", "treatment of migraine")]
    chunks = spark.createDataFrame(texts, "item_id string, text string")
    encoder = retrieval.fit_encoder(chunks)
    coded = retrieval.embed(chunks, encoder).collect()
    assert all(len(r["embedding"]) == 384 and abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in coded)
    queries = spark.createDataFrame([(1, "sepsis treatment")], "query_id int, query_text string")
    cands = spark.createDataFrame([(1, "c1"), (1, "c2"), (1, "c3")], "query_id int, item_id string")
    got = retrieval.rerank(cands, queries, chunks, 2).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == ["c1", "c3"] and got[0]["rerank_score"] > got[1]["rerank_score"] > 0
    by_length = retrieval.rerank(cands, queries, chunks, 1, scorer=F.length("text").cast("double")).collect()
    assert by_length[0]["item_id"] == "c1"


def test_bm25_formula(spark):
    pairs = spark.createDataFrame([(1, "a", "x y y", "x x z"), (1, "b", "x y y", "y q q q q")], "query_id int, item_id string, query_text string, text string")
    got = {r["item_id"]: r["rerank_score"] for r in retrieval.bm25_scores(pairs).collect()}
    idf = np.log(1 + (2 - 1 + 0.5) / 1.5)
    norm = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 4))
    assert got["a"] == pytest.approx(idf * norm(2, 3), abs=1e-9) and got["b"] == pytest.approx(idf * norm(1, 5), abs=1e-9)


def test_context(spark):
    rows = [(1, 2, "C2", " b "), (1, 1, "C1", "a" * 2000)]
    df = spark.createDataFrame(rows, "query_id int, rank int, citation string, text string")
    assert retrieval.context_block(df).first()["context"] == f"[1] (source: C1)\n{'a' * 1500}\n\n[2] (source: C2)\nb"


def test_context_without_text_or_citation(spark):
    rows = [(1, 1, "C1", None), (1, 2, None, "b"), (1, 3, "C3", "c"), (2, 1, "C1", None), (3, 1, "C1", "")]
    df = spark.createDataFrame(rows, "query_id int, rank int, citation string, text string")
    got = {r["query_id"]: r["context"] for r in retrieval.context_block(df).collect()}
    head = "[1] (source: C1)\n"
    assert got == {1: f"{head}\n\n[2] (source: )\nb\n\n[3] (source: C3)\nc", 2: head, 3: head}


# --- evaluation


def metrics(spark, got, gold, k=5):
    ranked = spark.createDataFrame([(1, r, d) for r, d in enumerate(got, 1)], "query_id int, rank int, doc_id string")
    wanted = spark.createDataFrame([(1, d) for d in gold], "query_id int, doc_id string")
    return retrieval_eval.retrieval_metrics(ranked, wanted, k).first()


def test_metric_vectors(spark):
    third = metrics(spark, ["x", "y", "g", "z", "w"], ["g"])
    assert third["mrr"] == pytest.approx(1 / 3) and third["hit"] == 1 and third["p_at_1"] == 0 and third["p_at_3"] == pytest.approx(1 / 3)
    none = metrics(spark, ["x"], ["g"])
    assert (none["hit"], none["mrr"], none["ndcg"], none["recall"]) == (0, 0.0, 0.0, 0.0)
    copies = metrics(spark, ["g", "g", "g"], ["g"])
    assert copies["recall"] == 1.0 and copies["p_at_k"] == pytest.approx(0.6) and copies["ndcg"] == pytest.approx(1.0)
    perfect = metrics(spark, ["a", "b", "x", "y", "z"], ["a", "b"])
    assert perfect["ndcg"] == pytest.approx(1.0) and perfect["p_at_k"] == pytest.approx(0.4)
    first, later = metrics(spark, ["a", "x", "x"], ["a", "b"]), metrics(spark, ["x", "x", "a"], ["a", "b"])
    assert first["ndcg"] > later["ndcg"] and first["recall"] == 0.5
    assert retrieval_eval.discount(1) == [1.0] and retrieval_eval.ideal(0) == [0.0]


def test_question_without_results_scores_zero(spark):
    ranked = spark.createDataFrame([(1, 1, "g")], "query_id int, rank int, doc_id string")
    gold = spark.createDataFrame([(1, "g"), (2, "h")], "query_id int, doc_id string")
    summary = retrieval_eval.retrieval_summary(retrieval_eval.retrieval_metrics(ranked, gold)).first()
    assert summary["n"] == 2 and summary["hit"] == 0.5 and summary["mrr"] == 0.5
    lift = retrieval_eval.rerank_lift(ranked.where("rank > 1"), ranked, gold).first()
    assert lift["hit_rate_retrieval_only"] == 0 and lift["hit_rate_reranked"] == 0.5 and lift["hit_rate_lift"] == 0.5


def test_tool_calls(spark):
    rows = [
        (["search_guidelines"], ["search_guidelines", "search_guidelines"], 1, 4),
        (["search_guidelines"], ["search_guidelines", "get_hospital_kpis"], 1, 6),
        ([], [], 1, 2),
        ([], ["made_up"], 0, 2),
        (["get_doctor_stats"], [], 0, 0),
    ]
    log = spark.createDataFrame(rows, "expected array<string>, called array<string>, completed int, steps long")
    got = [(r["exact_match"], r["partial_match"], r["invalid_calls"]) for r in retrieval_eval.tool_call_rows(log).collect()]
    assert got == [(1, 1, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1), (0, 0, 0)]
    total = retrieval_eval.tool_call_scores(log).first()
    assert total["exact_accuracy"] == pytest.approx(0.4) and total["invalid_calls"] == 1 and total["avg_steps"] == pytest.approx(2.8)


def test_answers(spark):
    rows = [("see [1]", 2.0), ("no source", 4.0), (None, 9.0)]
    got = retrieval_eval.answer_checks(spark.createDataFrame(rows, "answer string, latency double")).first()
    assert (got["answered"], got["failed"], got["avg_latency"], got["max_latency"], got["citation_rate"]) == (2, 1, 3.0, 4.0, 0.5)


# --- stores


def test_ingest_twice_adds_nothing(spark, tmp_path):
    schema = ingest.DOCUMENT_SCHEMA
    rows = [(f"d{i}", "City Hospital", f"t{i}", "u", f"text number {i} " * 20) for i in range(6)]
    df = spark.createDataFrame(rows, schema)
    encoder = retrieval.fit_encoder(df)
    paths = [str(tmp_path / p) for p in ("in", "store", "ck")]
    df.where("doc_id < 'd3'").write.parquet(paths[0])
    ingest.ingest_new_files(spark, *paths, encoder)
    assert ingest.live_chunks(spark, paths[1]).count() == 3
    df.where("doc_id >= 'd2'").write.mode("append").parquet(paths[0])  # d2 comes a second time
    for _ in range(2):
        ingest.ingest_new_files(spark, *paths, encoder)
    found = ingest.live_chunks(spark, paths[1], "city_hospital")
    assert sorted(r["doc_id"] for r in found.collect()) == [f"d{i}" for i in range(6)]
    assert tenants.counts(spark, f"{paths[1]}/chunks").first()["chunks"] == 6


def test_changed_late_and_retried_documents(spark, tmp_path):
    store = str(tmp_path / "store")
    text = lambda word: f"{word} patient notes " * 20
    schema = ingest.DOCUMENT_SCHEMA + ", file_time timestamp, content string"
    encoder = retrieval.fit_encoder(spark.createDataFrame([(text("old"),), (text("new"),)], "text string"))

    def batch(*rows):
        made = [(doc, who, "t", None, body, dt.datetime(2020, 1, 1, 0, 0, when), "x") for doc, who, body, when in rows]
        return spark.createDataFrame(made, schema)

    def shown():
        return sorted((r.tenant_id, r.doc_id, r.text.split()[0]) for r in ingest.live_chunks(spark, store).collect())

    first = batch(("d1", "A", text("old"), 10), ("d2", "A", text("old"), 10), ("d1", "B", text("old"), 10), (None, "A", text("old"), 10))
    assert ingest.store_documents(first, store, 0, encoder) == 3
    # d1 of A changes twice in one batch, d2 comes again unchanged, another tenant's d1 stays
    second = batch(("d1", "A", text("middle"), 20), ("d1", "A", text("new"), 30), ("d2", "A", text("old"), 40))
    assert ingest.store_documents(second, store, 1, encoder) == 1
    assert shown() == [("a", "d1", "new"), ("a", "d2", "old"), ("b", "d1", "old")]
    # a late file with an older version
    assert ingest.store_documents(batch(("d1", "A", text("late"), 15)), store, 2, encoder) == 0
    # the batch before runs again, as after a crash between its writes and the checkpoint
    assert ingest.store_documents(second, store, 1, encoder) == 1
    assert shown() == [("a", "d1", "new"), ("a", "d2", "old"), ("b", "d1", "old")]
    # back to the first content: newest file counts, the chunks stored for it long ago don't come back twice
    assert ingest.store_documents(batch(("d1", "A", text("old"), 50)), store, 3, encoder) == 1
    assert shown() == [("a", "d1", "old"), ("a", "d2", "old"), ("b", "d1", "old")]
    # chunks of a batch whose log lines were never written are not seen
    half = ingest.live_chunks(spark, store).where("doc_id = 'd2'").drop("batch", "seq").withColumn("seq", F.lit(9).cast("bigint"))
    tenants.append(half, f"{store}/chunks", "batch-9")
    assert len(shown()) == 3


def test_index_append_against_the_chunker(spark):
    import os

    from wardlake import clinical
    from wardlake.functions.scalars import clean_text
    from wardlake.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    want = {}
    cleaned = clinical.documents(spark, sf).select("doc_id", "source", clean_text(F.col("text")).alias("text"))
    for row in tenants.with_tenant(cleaned).collect():
        pieces = chunk_text(row.text or "")
        if pieces:
            chunks, documents = want.get(row.tenant_id, (0, 0))
            want[row.tenant_id] = chunks + len(pieces), documents + 1
    rows = QUERIES["index_append"](spark, sf).collect()
    assert {r.tenant_id: (r.chunks, r.documents) for r in rows} == want and all(r.vectors == r.chunks for r in rows)


def test_tenant_search_stays_inside(spark, tmp_path):
    _, chunks = vectors(spark, 90)
    for batch in ("a", "a"):
        tenants.append(chunks, str(tmp_path / "s"), batch)
    assert tenants.read_store(spark, str(tmp_path / "s")).count() == 90
    own = tenants.read_store(spark, str(tmp_path / "s"), "t1")
    assert {r["chunk_id"] % 3 for r in own.select("chunk_id").collect()} == {1}
