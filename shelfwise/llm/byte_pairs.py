"""Byte-level BPE with a sentencepiece model made from a rank file.

The model is serialised here, not trained: every token of the vocabulary becomes a
piece, its bytes written as the printable characters that byte-level vocabularies
use, its score the negative rank, so that sentencepiece merges lowest ranks first.
The normaliser is the identity. Pre-tokens are encoded one by one; a pre-token that
is itself a token takes that token. Decoding maps ids back to their bytes.

Null and empty texts have no ids; bytes that are no UTF-8 cannot occur in a Spark
string. Texts of any length are handled piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.chunked import (
    PieceEncoder,
    batches_of,
    byte_characters,
    byte_level_words,
    pieces_with_spaces,
    rows,
    to_byte_characters,
)


#: Pieces kept in memory, half of what other encoders keep: here two Python workers
#: stand behind each running task.
REMEMBERED = 125_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks must be 0, 1, 2, ...")
    return tokens


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; one unknown piece follows."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    table = dict(enumerate(byte_characters()))
    model = proto.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=token.decode("latin-1").translate(table), score=-float(rank))
    kinds = proto.ModelProto.SentencePiece
    model.pieces.add(piece="<unk>", score=-float(len(tokens)), type=kinds.UNKNOWN)
    trainer = model.trainer_spec
    trainer.model_type = proto.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(tokens), -1, -1, -1
    normal = model.normalizer_spec
    normal.name = "identity"
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


@cache
def _parts(ranks_path: str):
    import sentencepiece

    tokens = read_ranks(ranks_path)
    processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
    return tokens, processor, {token: rank for rank, token in enumerate(tokens)}


def rank_encoder(ranks_path: str, pattern: str) -> PieceEncoder:
    _, processor, whole = _parts(ranks_path)

    def tokenise(word: str) -> list[int]:
        rank = whole.get(word.encode())
        return [rank] if rank is not None else processor.encode(to_byte_characters(word))

    return PieceEncoder(pieces_with_spaces, byte_level_words(pattern), tokenise, remembered=REMEMBERED)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)``, the ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks_path, pattern)
        yield from batches_of(((i, encoder(t)) for i, t in rows(batches, ["doc_id", "text"])), schema)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, ids binary")


def decode_ids(tokens: list[bytes], ids: bytes) -> bytes:
    """The bytes that ids stand for, by the inverse of the vocabulary."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of ``encoded``, ``(doc_id, ids)``, with ``decoded``: the bytes of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _parts(ranks_path)[0]
        yield from batches_of(((d, ids, decode_ids(tokens, ids)) for d, ids in rows(batches, ["doc_id", "ids"])), schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: of the decimal ids joined by
    one space, and of the bytes they decode to. The bytes need not leave the task."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(ranks_path)
        decimal = [str(rank) for rank in range(len(tokens))]

        def each() -> Iterator[tuple]:
            for doc_id, ids in rows(batches, ["doc_id", "ids"]):
                numbers = np.frombuffer(ids, "<u4").tolist()
                text = " ".join([decimal[n] for n in numbers])
                decoded = decode_ids(tokens, ids)
                yield doc_id, len(numbers), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

        yield from batches_of(each(), schema)

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
