"""The pipeline's stages, each on its own input, and as a whole."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from shelfwise.llm.queries import LLM_QUERIES, pack_tokenizer
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_operators import plain_measures
from tests.llm.test_queries import check_packing

SF_DIR = f"{DATA}/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [r.asDict() for r in docs.collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF_DIR)
        result.write.parquet(str(tmp_path / name))
        before, docs = kept, spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        kept = [r.asDict() for r in docs.collect()]
        assert all(row in before for row in kept)
        texts = {r["doc_id"]: r["text"] for r in before}
        left = {r["doc_id"] for r in kept}
        if name == "toxicity":
            assert 0.7 * len(before) < len(kept) < len(before)
        if name == "quality_rules":
            for doc_id, text in texts.items():
                n, _, _, _, repeated = plain_measures(text)
                assert (doc_id in left) == (n >= 20 and 100 * repeated <= 30 * n)
        if name == "near_duplicates":
            groups = brute.components({i: brute.fingerprint(t) for i, t in texts.items()}, 4)
            assert left == set(groups.values())
    encode = pack_tokenizer().one
    ids = {r["doc_id"]: [*np.frombuffer(encode(r["text"]), "<u4").tolist(), 1] for r in kept}
    assert check_packing(docs.collect(), ids, 2048) < 0.05


def test_run_gives_packed_documents(spark):
    rows = LLM_QUERIES["pipeline"](spark, SF_DIR).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
