"""Token counts of whole texts, huge ones by overlapping chunks.

A text of at most ``chunk`` characters is encoded at once. A longer one is cut into
chunks that overlap, each encoded with offsets, so that a task never holds the tokens of
more than two chunks. Neighbours are spliced where both begin a pre-token. That is a
boundary of the whole text as well, because the byte-level pattern looks forward only:

* What ends before a boundary of the left chunk is decided by the characters up to it
  and, for white space and added tokens, by a few behind it. Those few, the ``margin``,
  must lie inside the chunk, and so must one whole pre-token behind the boundary: a run
  of white space that the chunk's end cuts is never spliced in.
* What begins at a boundary does not depend on what stands before it. So from there on
  the right chunk's tokens are those of the whole text.

Where no boundary is common, as in a long run of letters without a space, the left chunk
begins at the last splice and the overlap is doubled until one is, or the text ends.

Only tokenizer files whose pre-tokens are found this way (byte level with its own
pattern, no normaliser) are spliced; others raise an error. Added tokens count as the
library counts them: one each. Null and empty texts have no bytes and no tokens. Rows
without an id and repeated rows stay; other columns are not read. An empty table gives
no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of an overlap, and texts encoded in one call.
CHUNK, OVERLAP, TOGETHER = 1 << 16, 1 << 10, 64
#: Tokens beyond which a document is over the limit.
LIMIT = 1024


class TokenCounter:
    """Numbers of tokens by one ``tokenizers`` file; see the module's text."""

    def __init__(self, tokenizer_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        steps = json.loads(self.tokenizer.to_str())
        pre = steps["pre_tokenizer"] or {}
        own_pattern = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if steps["normalizer"] or not own_pattern:
            raise ValueError(f"no common boundary can be proven for {tokenizer_file}")
        for token in steps["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"added token {token['content']!r} looks at its neighbours")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.margin = 1 + max((len(token["content"]) for token in steps["added_tokens"]), default=0)
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than the chunk")
        self.chunk, self.overlap = chunk, overlap

    def __call__(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        short = [text for text in texts if len(text) <= self.chunk]
        numbers = iter(map(len, self.tokenizer.encode_batch_fast(short, add_special_tokens=False)))
        return [next(numbers) if len(text) <= self.chunk else self.spliced(text) for text in texts]

    def boundaries(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where pre-tokens of ``text[start:end]`` begin in the text, the tokens before
        each of them, and all its tokens."""
        found = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        words = np.array(found.word_ids, float)  # a token without a pre-token becomes NaN, unlike any other
        first = np.flatnonzero(np.diff(words, prepend=-1.0) != 0)
        at = np.fromiter((offset[0] for offset in found.offsets), np.int64, len(words))[first]
        return at + start, first, len(words)

    def common(self, left: np.ndarray, right: np.ndarray, end: int) -> int | None:
        """The first place where pre-tokens of both chunks begin and the left one's are
        proven; ``end`` is where the left chunk ends."""
        proven = left[:-1]
        proven = proven[proven + self.margin <= end]
        shared = np.intersect1d(proven, right, assume_unique=True)
        return int(shared[0]) if len(shared) else None

    def spliced(self, text: str) -> int:
        """The number of tokens of a text longer than a chunk."""
        total, since, end = 0, 0, self.chunk  # tokens before ``since``, a boundary of the whole text
        left, before, tokens = self.boundaries(text, since, end)
        while end < len(text):
            overlap, start = self.overlap, max(since + 1, end - self.overlap)
            right_end = min(len(text), start + self.chunk)
            right, counts, its_tokens = self.boundaries(text, start, right_end)
            joint = self.common(left, right, end)
            while joint is None:
                overlap *= 2
                end = min(len(text), end + overlap)
                left, before, tokens = self.boundaries(text, since, end)
                if end == len(text):
                    return total + tokens
                if end >= right_end:
                    right_end = min(len(text), end + self.chunk)
                    right, counts, its_tokens = self.boundaries(text, start, right_end)
                joint = self.common(left, right, end)
            total += int(before[np.searchsorted(left, joint)])
            place = np.searchsorted(right, joint)
            since, end, tokens = joint, right_end, its_tokens - int(counts[place])
            left, before = right[place:], counts[place:] - counts[place]
        return total + tokens


@cache
def counter(tokenizer_file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> TokenCounter:
    """One counter per worker process."""
    return TokenCounter(tokenizer_file, chunk, overlap)


def count_tokens(
    docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs(doc_id, text)``.

    ``tokenizer_file`` must lie at the same place on every machine.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_file, chunk, overlap)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(start, TOGETHER)
                numbers = pa.array(count(some.column("text").to_pylist()), pa.int64())
                columns = [some.column("doc_id"), some.column("n_bytes"), numbers]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    counted = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
