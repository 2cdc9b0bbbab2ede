"""Quality rules for documents and for the hosts they come from.

Every document is measured over its whole text and fails the base rules when it has
too few words or too many of them in repeated windows. Failures are counted by host
(here: the column ``source``). A beta prior is fitted to the hosts' failure rates by
their mean and variance and each host's rate is shrunk towards it. A host is rejected
with all its documents when even the lower bound of its shrunk rate passes a limit.

Null texts have no words. Documents without a host count towards no host and stand by
their own rules. Repeated rows are judged as often as they occur. An empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.whole_rows import back, whole_row
from shelfwise.sources.scratch import cut_lineage

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
#: The prior's strength where hosts differ by chance only.
NO_VARIANCE = 1e9
#: A host is rejected when more than this share of its documents must be taken to fail,
#: so many posterior standard deviations below the mean.
MOST_FAILING, BOUND_DEVIATIONS = 0.5, 1.645
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_TYPE = pa.struct([(name, pa.int64()) for name in MEASURES])
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included.

    Hashes find windows that may be equal; only those are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += hashes[k : k + n] * _FACTORS[k]
    ordered = np.sort(mixed)
    equal = ordered[1:] == ordered[:-1]
    if not equal.any():
        return 0
    places = np.flatnonzero(np.isin(mixed, ordered[1:][equal])).tolist()
    windows = [tuple(words[i : i + window]) for i in places]
    often = Counter(windows)
    covered = np.zeros(len(words), bool)
    for i, found in zip(places, windows):
        if often[found] > 1:
            covered[i : i + window] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The document's MEASURES."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()  # ASCII white space only, as wanted
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([dict(zip(MEASURES, measure(text.as_py()))) for text in texts], _TYPE)


def measures(text: str) -> Column:
    run = F.arrow_udf(_measures, ", ".join(f"{name} long" for name in MEASURES))
    return run(F.col(text).cast("string"))


def base_failed(stats: str) -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MOST_REPEATED_PERCENT * n)


def host_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the beta prior, from ``(host, n, failed)``.

    The strength follows from the variance between hosts that sampling alone does not
    explain. Where there is none, every host gets the common rate.
    """
    n, k = F.col("n"), F.col("failed")
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum(n).alias("n"),
        F.sum(k).alias("k"),
        F.sum(k * k / n).alias("squares"),
        F.sum(n * n).alias("n_squares"),
    ).first()
    if not sums.n:
        return 0.0, 1.0
    mean = sums.k / sums.n
    sampling = mean * (1 - mean)
    weight = sums.n - sums.n_squares / sums.n
    between = sums.squares - sums.k * sums.k / sums.n - (sums.hosts - 1) * sampling
    if between <= 0 or weight <= 0:
        return mean, NO_VARIANCE
    return mean, max(sampling * weight / between - 1, 1.0)


def host_verdicts(outcomes: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """``(host, n, failed, rate, rejected)`` from rows ``(host, failed)``; ``rate`` is
    the posterior mean."""
    counts = (
        outcomes.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))
    )
    hosts = cut_lineage(counts, "hosts")
    mean, strength = host_prior(hosts)
    total = F.col("n") + strength
    rate = (F.col("failed") + mean * strength) / total
    bound = rate - BOUND_DEVIATIONS * F.sqrt(rate * (1 - rate) / (total + 1))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.round(bound, 9) > most_failing)


def _judged(docs: DataFrame, carry: Column, host: str, text: str) -> DataFrame:
    """``(carry, stats, failed, kept)``."""
    measured = docs.select(
        carry, F.col(host).cast("string").alias("host"), measures(text).alias("stats")
    )
    stored = cut_lineage(measured.withColumn("failed", base_failed("stats")), "quality")
    verdicts = host_verdicts(stored).where("rejected").select("host", "rejected")
    judged = stored.join(cut_lineage(verdicts, "rejected_hosts"), "host", "left")
    return judged.withColumn("kept", ~F.col("failed") & F.col("rejected").isNull())


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, MEASURES, base_failed, kept)`` of every row."""
    return _judged(docs, F.col("doc_id"), host, text).select(
        "doc_id", "stats.*", F.col("failed").alias("base_failed"), "kept"
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, as they are."""
    return back(_judged(docs, whole_row(), host, text).where("kept"))
