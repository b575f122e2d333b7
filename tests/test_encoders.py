import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.operators import encoders, retrieval

def test_model_is_loaded_once_per_worker_and_feeds_the_search(spark, tmp_path):
    noted = str(tmp_path / "loads.txt")

    def noting_load(files):
        """Loads the trigram model and leaves a line saying which process did."""
        with open(noted, "a") as out:
            out.write(f"{os.getpid()}\n")
        return encoders.load_trigram_model(files)

    rows = [(i, t) for i, t in enumerate(["sepsis treatment with fluids", "the menu of the week", "treatment of migraine", "", None, "menu week"] * 40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(8)
    path = encoders.save_trigram_model(str(tmp_path / "trigrams.npy"))
    column = encoders.model_encoder(spark, [path], noting_load)
    coded = retrieval.embed_with(chunks, column)
    got = {r.chunk_id: r.embedding for r in coded.collect()}
    assert coded.agg(F.count("embedding")).first()[0] == 160  # a second job
    plain = encoders.load_trigram_model([path])
    for i, text in rows:
        if not text:  # no trigram, so no direction
            assert got[i] is None
        else:
            vector = plain([text])[0]
            assert np.allclose(got[i], vector / np.linalg.norm(vector), atol=1e-6)
    loads = open(noted).read().split()
    assert 1 <= len(loads) == len(set(loads)) <= 16  # eight tasks twice, no process loads twice
    asked = spark.createDataFrame([(1, "migraine treatment"), (2, "weekly menu")], "query_id long, text string")
    found = retrieval.vector_topk(coded, retrieval.embed_with(asked, column), 40)
    best = {r.query_id: {rows[x.item_id][1] for x in found.collect() if x.query_id == r.query_id} for r in asked.collect()}
    assert best == {1: {"treatment of migraine"}, 2: {"menu week"}}


def test_two_files_of_one_name_are_refused(spark):
    with pytest.raises(ValueError):
        encoders.model_encoder(spark, ["/a/m.npy", "/b/m.npy"], encoders.load_trigram_model)
