"""The pipeline against its decisions made one by one in plain Python."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest import SF
from test_operators import brute_components
from tokenizers import Tokenizer

from presslight.llm import quality


def test_pipeline(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = corpus_pipeline.table(spark, sf, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.written(stage(spark, kept[-1], sf), f"test-{name}"))
    assert all(df.columns == docs.columns for df in kept[:-1])

    model = quality.fit(docs, corpus_pipeline.table(spark, sf, "labels"))

    def score(text):
        at, n = quality.bag(text or "")
        return model.score(float((model.weights[at] * n).sum()), int(n.sum()))

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i for i, t in rows.items() if score(t) >= 0.3}
    assert {r["doc_id"] for r in kept[1].select("doc_id").collect()} == good
    labels = corpus_pipeline.table(spark, sf, "labels").toPandas().set_index("doc_id")["quality"]
    assert np.mean([i in good for i in labels.index[labels == 1]]) > 0.97

    part = sorted(good)
    groups = brute_components([(i, rows[i]) for i in part], 5, 80)
    alone = {i for i, (_, c) in groups.items() if i == c}
    assert {r["doc_id"] for r in kept[2].select("doc_id").collect()} == alone

    mixed = kept[3].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= alone and max(r["count"] for r in mixed) <= 3
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = kept[4].collect()
    assert len(last) == sum(r["count"] for r in mixed)
    for r in last[:100]:
        ids = tokenizer.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
