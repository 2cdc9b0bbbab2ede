from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


PARTS = [
    " ", "  ", "\n", "\n\n  ", "\t", "　", "'s", "'re", "'", "'l", "ll", "<|endoftext|>", "<|endo", "ftext|>", "<", "|>",
    "word", "x", "été", "日本語", "🙂", "123", "4", "...", "!!", "né", "​", "\x00",
]


@pytest.mark.parametrize("chunk, overlap", [(24, 4), (40, 16), (64, 40), (200, 30)])
def test_chunks_count_like_the_whole(whole, chunk, overlap):
    rng = random.Random(chunk)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 400))) for _ in range(300)]
    texts += ["a" * 999, " " * 999, "\n" * 500 + "x", "é" * 700, "<|endoftext|>" * 60, "ab " * 400, "x" * 500 + " y" * 300]
    counter = token_counts.TokenCounter(FILE, chunk, overlap)
    assert counter(texts) == whole(texts)


def test_alignment_fails_and_the_overlap_widens(whole, monkeypatch):
    counter = token_counts.TokenCounter(FILE, 64, 16)
    text = "start " + "q" * 1000 + " " + "word " * 100
    spans = []
    boundaries = counter.boundaries
    monkeypatch.setattr(counter, "boundaries", lambda t, a, b: spans.append((a, b)) or boundaries(t, a, b))
    assert counter([text]) == whole([text])
    assert max(b - a for a, b in spans) > 1000
    assert max(b - a for a, b in spans[-3:]) <= 128  # back to chunks


def test_chunks_bound_what_is_encoded_at_once(monkeypatch):
    counter = token_counts.TokenCounter(FILE, 4096, 256)
    spans = []
    boundaries = counter.boundaries
    monkeypatch.setattr(counter, "boundaries", lambda t, a, b: spans.append(b - a) or boundaries(t, a, b))
    counter(["some ordinary words, " * 20_000])
    assert max(spans) <= 4096


def test_rows(spark, odd_documents, whole):
    rows = odd_documents.select("doc_id", "text").collect()
    clashing = odd_documents.selectExpr("*", "1 as n_tokens", "2 as n_bytes")
    found = token_counts.count_tokens(clashing, FILE, limit=5, chunk=300, overlap=32).collect()
    expected = [
        (r.doc_id, len((r.text or "").encode()), n, n > 5) for r, n in zip(rows, whole([r.text or "" for r in rows]))
    ]
    assert sorted(map(tuple, found), key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) == sorted(
        expected, key=lambda r: (r[0] is None, r[0] or 0, *r[1:])
    )


def test_no_rows(no_documents):
    assert token_counts.count_tokens(no_documents, FILE).collect() == []


def test_files_without_proven_boundaries_are_refused():
    with pytest.raises(ValueError, match="no common boundary"):
        token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
