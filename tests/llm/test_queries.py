"""The registered queries against SQL, or against plain code where SQL has no words for them."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from shelfwise.llm import toxicity
from shelfwise.llm.oracle import LLM_SQL
from shelfwise.llm.queries import CATEGORIES, LLM_QUERIES, chain_labels
from tests.compare import connect, difference
from tests.conftest import DATA
from tests.llm import brute

SF_DIR = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def texts(duck):
    rows = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    return dict(rows)


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_matches_sql(spark, duck, name):
    assert difference(LLM_QUERIES[name](spark, SF_DIR), duck, LLM_SQL[name]) is None


def _tokenizer(name: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_token_store(spark, texts):
    found = {r.doc_id: r for r in LLM_QUERIES["op1_token_store"](spark, SF_DIR).collect()}
    assert found.keys() == texts.keys()
    encoded = _tokenizer("word_bpe_49k.json").encode_batch(list(texts.values()), add_special_tokens=False)
    start = 0
    for doc_id, ids in zip(texts, (e.ids + [2] for e in encoded)):
        row = found[doc_id]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_byte_pairs(spark, texts):
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in LLM_QUERIES["op6_byte_pairs"](spark, SF_DIR).collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids, row = plain.encode_ordinary(text), found[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def check_packing(rows, encoded: dict, capacity: int) -> float:
    """Every id in one piece, sequences gapless and within capacity; the padding's share."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append(row)
    assert pieces.keys() == encoded.keys()
    for doc_id, ids in encoded.items():
        data, at = np.array(ids, "<u4").tobytes(), 0
        for row in sorted(pieces[doc_id], key=lambda r: r.start):
            assert row.start == at and row.doc_tokens == len(ids)
            at += row.length
            assert row.ids_crc32 == zlib.crc32(data[4 * row.start : 4 * at])
        assert at == len(ids)
    padding = 0
    for members in sequences.values():
        at = 0
        for row in sorted(members, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert 0 < at <= capacity
        padding += capacity - at
    return padding / (capacity * len(sequences))


def test_packing(spark, texts):
    encoded = _tokenizer("byte_bpe_50k.json").encode_batch(list(texts.values()), add_special_tokens=False)
    ids = {doc_id: e.ids + [1] for doc_id, e in zip(texts, encoded)}
    rows = LLM_QUERIES["op7_packing"](spark, SF_DIR).collect()
    assert check_packing(rows, ids, 2048) < 0.02


def test_simhash(spark, texts):
    found = {r.doc_id: r for r in LLM_QUERIES["op8_simhash"](spark, SF_DIR).collect()}
    prints = {doc_id: brute.fingerprint(text) for doc_id, text in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    assert all(len(r.fingerprint) == 16 for r in found.values())
    assert {i: r.component_id for i, r in found.items()} == brute.components(prints, 4)


def test_toxicity(spark, duck):
    """Trained and judged on the larger sample; labelled documents outside the training
    folds are not apart here, so the margin is on all labels, which hold some noise."""
    sf_dir = f"{DATA}/sf0.1"
    found = {r.doc_id: r.toxic for r in LLM_QUERIES["op10_toxicity"](spark, sf_dir).collect()}
    labels = connect(sf_dir).execute("SELECT doc_id, toxic FROM labels").fetchall()
    toxic = [found[i] for i, label in labels if label]
    clean = [found[i] for i, label in labels if not label]
    assert sum(toxic) / len(toxic) > 0.85
    assert sum(clean) / len(clean) < 0.01


def test_toxicity_of_labels_kept_out_of_training(spark):
    sf_dir = f"{DATA}/sf0.1"
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), chain_labels(spark, sf_dir)
    kept_out = labels.where("pmod(xxhash64(doc_id, 'held out'), 4) = 0").select("doc_id", "toxic")
    chain = toxicity.fitted(documents, labels.join(kept_out, "doc_id", "left_anti"), CATEGORIES)
    rows = documents.select("doc_id", "text").join(kept_out, "doc_id").collect()
    toxic = [chain(r.text)[-1] > toxicity.LIMIT for r in rows if r.toxic]
    clean = [chain(r.text)[-1] > toxicity.LIMIT for r in rows if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.9
    assert sum(clean) / len(clean) < 0.01


def test_token_counts(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)
    expected = {i: (len(t.encode()), len(e.ids), len(e.ids) > 1024) for (i, t), e in zip(texts.items(), encoded)}
    found = LLM_QUERIES["op13_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in found} == expected


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in LLM_QUERIES
