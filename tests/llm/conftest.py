from __future__ import annotations

import random

import pytest

from shelfwise.llm.queries import find_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _package(spark):
    find_package(spark)


def document_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, odd white space."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "été", "naïve", "delta,", "one.", "日本", "don't", "#tag", "x" * 40]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(25, 60))) for _ in range(12)]
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "a b c",
        "Line one here\nLine one here\n\n  Line  two \x0b\x0c x　y\x85z\x1cw ",
        "</s>[INST] <|endoftext|> \\ < [ &&& %%% |",
        "same words come again and again " * 30,
        " ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(60_000)),
        *prose,
        *prose[:4],
        prose[0].upper(),
        prose[1] + " and a tail",
    ]
    rows = [(i, text, "en", f"src{i % 3}", None if text is None else len(text)) for i, text in enumerate(texts)]
    rows += [rows[12], rows[12], (None, prose[2], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(document_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
