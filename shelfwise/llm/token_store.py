"""Token ids of documents in compressed binary blocks, each document readable alone.

One zstandard dictionary is trained on the serialised ids of a bounded sample. Every
document is a frame of its own, compressed with that dictionary; frames lie in blocks
in ascending document order. A block holds:

    8 bytes   magic
    32 bytes  SHA-256 of the dictionary
    8 bytes   number of documents n
    8 n       document ids, signed; 0 for a null id
    n         1 for each document that has an id, else 0
    8 n       ids before the document, within its slice
    8 (n + 1) offsets of the frames, counted from the end of this header
    frames

All numbers are little-endian. Blocks are rows of a parquet table with the first and
last document id beside them, so that a reader finds one document's block by its
statistics, seeks its frame by the offset and decompresses nothing else. Parquet
gives atomic commits: a repeated task leaves no second copy.

Null and empty texts hold only the end id. Rows without an id come first, repeated
ids stay, in the order of their frames' hashes. An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.chunked import CHARACTERS, batches_of, encoded_rows, rows
from shelfwise.sources.scratch import cut_lineage

MAGIC = b"IDBLOCK1"
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: Documents that the dictionary is trained on, and characters of a stretch of each,
#: which begins at a random place.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 1000, 16 << 10
BLOCK_BYTES = 1 << 20

#: Gives, in a task, the function from texts to their ids.
Encoder = Callable[[], Callable[[list[str | None]], list[bytes]]]

_FRAMES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
_BLOCKS = pa.schema(
    [
        ("slice", pa.int32()),
        ("first_doc", pa.int64()),
        ("last_doc", pa.int64()),
        ("n_tokens", pa.int64()),
        ("block", pa.binary()),
    ]
)
_IDS = pa.schema([("slice", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=shared)


def _train(samples: list[bytes]) -> bytes:
    """The dictionary, or none where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def train_dictionary(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """One row ``(hash, dictionary)``, trained in one task on stretches of the documents
    whose hashed ids are smallest, begun at places that the hashed ids choose."""
    key = F.xxhash64("doc_id")
    last = docs.select(key.alias("key")).orderBy("key").limit(SAMPLE_DOCUMENTS)
    limit = last.agg(F.max("key")).scalar()
    room = F.greatest(F.length("text") - SAMPLE_CHARACTERS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), room).cast("int") + 1
    stretch = F.substring("text", start, F.lit(SAMPLE_CHARACTERS)).alias("text")
    sample = docs.where(key <= limit).select(stretch).limit(SAMPLE_DOCUMENTS)

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        samples = encode([text for (text,) in rows(batches, ["text"])])
        dictionary = _train([s for s in samples if s])
        yield pa.RecordBatch.from_pydict(
            {"hash": [hashlib.sha256(dictionary).hexdigest()], "dictionary": [dictionary]}
        )

    return sample.repartition(1).mapInArrow(train, "hash string, dictionary binary")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The store's dictionary; empty where there was nothing to train on."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(row.dictionary) if row else b""


def write_token_store(
    docs: DataFrame, path: str, encoder: Encoder, end_id: int, most_characters: int = CHARACTERS
) -> None:
    """Encode ``text`` of every row, append ``end_id`` and write the blocks below ``path``.

    A task encodes ``most_characters`` at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    train_dictionary(docs, encoder).write.parquet(f"{path}/dictionary")
    dictionary = read_dictionary(spark, path)
    digest, end = hashlib.sha256(dictionary).digest(), struct.pack("<I", end_id)

    def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compress = encoder(), _compressor(dictionary).compress

        def each() -> Iterator[tuple]:
            for doc_id, ids in encoded_rows(batches, encode, most_characters):
                ids += end
                yield doc_id, len(ids) // 4, compress(ids)

        yield from batches_of(each(), _FRAMES)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def each() -> Iterator[tuple]:
            start, held, size, first = 0, [], 0, 0

            def closed() -> tuple:
                named = next((doc_id for doc_id, _, _ in held if doc_id is not None), None)
                return part, named, held[-1][0], start - first, pack_block(held, digest)

            for doc_id, n_tokens, frame in rows(batches, ["doc_id", "n_tokens", "frame"]):
                held.append((doc_id, start, frame))
                start += n_tokens
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield closed()
                    held, size, first = [], 0, start
            if held:
                yield closed()

        yield from batches_of(each(), _BLOCKS)

    encoded = cut_lineage(docs.mapInArrow(frames, "doc_id long, n_tokens long, frame binary"), "frames")
    # The hash of the frame lets rows of one id, or without any, range over several tasks.
    order = ["doc_id", F.xxhash64("frame")]
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(
        blocks, "slice int, first_doc long, last_doc long, n_tokens long, block binary"
    ).write.parquet(f"{path}/blocks")


def pack_block(documents: list[tuple[int | None, int, bytes]], digest: bytes) -> bytes:
    """A block of ``(doc_id, start, frame)``."""
    ids, starts, frames = zip(*documents)
    offsets = np.cumsum([0, *map(len, frames)], dtype="<i8")
    head = MAGIC + digest + struct.pack("<q", len(ids))
    numbers, known = np.array([i or 0 for i in ids], "<i8"), bytes(i is not None for i in ids)
    return b"".join([head, numbers.tobytes(), known, np.array(starts, "<i8").tobytes(), offsets.tobytes(), *frames])


def unpack_index(block: bytes, digest: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids, starts and absolute frame offsets of a block."""
    if block[:8] != MAGIC or block[8:40] != digest:
        raise ValueError("not a block of this store's dictionary")
    n = struct.unpack_from("<q", block, 40)[0]
    ids, known = np.frombuffer(block, "<i8", n, 48).tolist(), block[48 + 8 * n : 48 + 9 * n]
    places = np.frombuffer(block, "<i8", 2 * n + 1, 48 + 9 * n)
    return [i if k else None for i, k in zip(ids, known)], places[:n], places[n:] + 48 + 9 * n + 8 * (2 * n + 1)


def _read(spark: SparkSession, path: str, blocks: DataFrame, wanted: frozenset[int] | None) -> DataFrame:
    dictionary = read_dictionary(spark, path)
    digest = hashlib.sha256(dictionary).digest()

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = _decompressor(dictionary).decompress

        def each() -> Iterator[tuple]:
            for part, block in rows(batches, ["slice", "block"]):
                ids, starts, offsets = unpack_index(block, digest)
                for i, doc_id in enumerate(ids):
                    if wanted is None or doc_id in wanted:
                        tokens = decompress(block[offsets[i] : offsets[i + 1]])
                        yield part, doc_id, int(starts[i]), tokens

        yield from batches_of(each(), _IDS)

    return blocks.select("slice", "block").mapInArrow(unpack, "slice int, doc_id long, start long, ids binary")


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document; ``ids`` as little-endian 32-bit
    integers, ``start`` counting the ids of all documents before it."""
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice, at most spark.sql.shuffle.partitions.
    shift = (
        blocks.groupBy("slice")
        .agg(F.sum("n_tokens").alias("n"))
        .select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    documents = _read(spark, path, blocks, None).join(F.broadcast(shift), "slice")
    return documents.select("doc_id", (F.col("start") + F.col("shift")).alias("start"), "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """``(doc_id, ids)`` of a few documents, opening only their frames."""
    wanted = frozenset(doc_ids)
    near = F.lit(False)
    for doc_id in wanted:
        near = near | ((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    blocks = spark.read.parquet(f"{path}/blocks").where(near)
    return _read(spark, path, blocks, wanted).select("doc_id", "ids")
