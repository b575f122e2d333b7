import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_every_stage_takes_effect_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(20)
    word = lambda: rng.choice("bcdfghjk") + rng.choice("aeiou") + rng.choice("lmnprst") + rng.choice("aeiou")
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(14)
    docs = {i: text(rng.randint(30, 120)) for i in range(200)}  # clean
    toxic = {i: " ".join("you idiot moron scum" if j % 5 == 0 else word() for j in range(60)) for i in range(300, 380)}
    copies = {400 + i: docs[i] for i in range(10)} | {420 + i: docs[20 + i] + " end" for i in range(10)}
    footer = "This footer line stands in many documents."
    footed = {500 + i: f"{text(50)}\n{footer}" for i in range(10)}
    leaks = {600 + i: f"{text(30)} {passage.upper()} {text(30)}" for i in range(5)}
    every = docs | toxic | copies | footed | leaks | {700: None, 701: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in every.items()]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in every], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = dict(docs) | {700: None, 701: ""}
    kept |= {i: t if i == 500 else t.removesuffix(f"\n{footer}") for i, t in footed.items()}
    pieces = defaultdict(dict)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id][r.start] = np.frombuffer(bytes(r.ids), dtype="<u4")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(pieces) == set(kept)
    for doc, want in kept.items():
        got = np.concatenate([ids for _, ids in sorted(pieces[doc].items())]).tolist()
        assert got == [*plain.encode(want or "", add_special_tokens=False).ids, 2]

    stage = frame
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, str(tmp_path))
        assert stage.columns == frame.columns, name
        assert dict(stage.dtypes) == dict(frame.dtypes), name
