"""Pack documents' token ids into sequences of a fixed capacity, with little padding.

Documents are encoded and cut: full pieces of the capacity from the start, then the
rest. Documents are dealt at random into groups of some thousand pieces, and each group is
packed by first-fit decreasing on its own: longest pieces first, each into the first
sequence with room, found in a tournament tree that holds the most room below each
node. Only lengths travel; ids can be cut again from the documents at any time.

Null and empty texts still hold their end id. Repeated rows are packed as often as
they occur, rows without an id like others. An empty table gives no sequences.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.chunked import CHARACTERS, batches_of, encoded_rows
from shelfwise.sources.scratch import cut_lineage

GROUP_PIECES = 8192
_PIECES = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot")]
)


def cut_documents(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[str | None]], list[bytes]]],
    end_id: int,
    capacity: int,
    seed: int = 0,
    most_characters: int = CHARACTERS,
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, lot)`` of every row.

    ``lot`` is a random number of the document, the same when a task is repeated. A task
    encodes ``most_characters`` at a time.
    """
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        lots = random.Random(f"{seed} {TaskContext.get().partitionId()}")

        def each() -> Iterator[tuple]:
            for doc_id, ids in encoded_rows(batches, encode, most_characters):
                ids = memoryview(ids + end)
                total, lot = len(ids) // 4, lots.getrandbits(62)
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    yield doc_id, start, len(part) // 4, zlib.crc32(part), total, lot

        yield from batches_of(each(), _PIECES, most_rows=16384)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(cut, ", ".join(f"{field.name} long" for field in _PIECES))


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, taken in the given order.

    ``room`` is a complete binary tree over the sequences; a node holds the most room
    of any sequence below it, so the first one that fits is found by going left
    wherever the left half has room.
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    sequences, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        sequences.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= length
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return sequences, offsets


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` instead of ``lot``.

    ``sequence_id`` holds the group above 32 bits and the group's sequence below.
    """
    stored = cut_lineage(pieces, "pieces")
    groups = max(1, math.ceil(stored.count() / group_pieces))

    def fit(group: pa.Table) -> pa.Table:
        columns = {n: group.column(n).to_numpy(zero_copy_only=False) for n in ("length", "lot", "start")}
        order = np.lexsort((columns["start"], columns["lot"], -columns["length"]))
        sequences, offsets = first_fit(columns["length"][order].tolist(), capacity)
        base = (int(columns["lot"][0]) % groups) << 32
        ordered = group.take(order).drop_columns(["lot"])
        ordered = ordered.append_column("sequence_id", pa.array(base + np.array(sequences, np.int64)))
        return ordered.append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"{c} {t}" for c, t in pieces.drop("lot").dtypes)
    grouped = stored.groupBy((F.col("lot") % groups).alias("pack_group"))
    return grouped.applyInArrow(fit, f"{schema}, sequence_id long, offset long")
