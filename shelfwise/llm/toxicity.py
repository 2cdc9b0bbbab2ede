"""Toxicity by a chain of linear classifiers over words.

Categories are predicted one after another, each from the document's words and from
the probabilities of the categories before it. While training, those probabilities are
out-of-fold: they come from models that have not seen the document, as they will when
the chain runs. Features are the shares of chosen words and of chosen beginnings of
words; they are chosen by how unevenly they occur, in a bounded sample of labelled
documents. Scoring reads every whole text in one pass.

Null and empty texts have no words and get the chain's base rates. A label that is null
counts as 0; several labels of one document as the highest. Where a category's labels
are all alike, or there are none, its probability is (positives + 1) / (labels + 2).
Repeated rows are judged alike; of a labelled id that stands on rows of different texts,
the text of the smallest hash is learnt from. An empty table gives no rows.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.chunked import batches_of, rows
from shelfwise.llm.whole_rows import back, whole_row
from shelfwise.sources.scratch import cut_lineage

#: Labelled documents that train the chain, and features chosen for each category.
MAX_LABELLED, MAX_FEATURES = 20_000, 768
#: So many of a category's features are chosen by chance on average, were all meaningless.
CHANCE_FEATURES = 0.05
FOLDS, LEAST_DOCUMENTS, BEGINNING = 3, 4, 5
#: Words added to a document's length, so that one word weighs less in a short one.
SMOOTHING = 50
#: The sample is small once it is reduced to shares; many tasks would only cost time.
TRAINING_PARTITIONS = 4
ITERATIONS, REGULARISATION = 30, 1e-3
LIMIT = 0.5
_EDGES = string.punctuation


def words_of(text: str | None) -> list[str]:
    return [word.strip(_EDGES) for word in text.lower().split()] if text else []


def feature_counts(words: list[str]) -> Counter:
    """Counts of words, and of beginnings, which end in a star."""
    found = Counter(words)
    for word, n in list(found.items()):
        if len(word) > BEGINNING:
            found[word[:BEGINNING] + "*"] += n
    found.pop("", None)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``(doc_id, text, targets)`` of labelled documents, those of the smallest hashed ids."""
    marks = [F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(c) for c in categories]
    chosen = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    targets = chosen.select("doc_id", F.array(*categories).alias("targets"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample's size is a parameter.
    text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    found = texts.join(F.broadcast(targets), "doc_id").groupBy("doc_id", "targets").agg(text)
    return cut_lineage(found, "labelled")


def least_distance(tested: int) -> float:
    """The chi-square that ``CHANCE_FEATURES`` of so many meaningless features reach."""
    share = min(1.0, CHANCE_FEATURES / max(1, tested))
    return NormalDist().inv_cdf(share / 2) ** 2


def choose_features(sample: DataFrame, categories: int) -> list[str]:
    """The features whose documents' labels differ most from the rest, by chi-square.

    The bound on it grows with the number of features tested, so that the many that
    occur unevenly by chance stay out.
    """
    fields = [("feature", pa.string()), ("n", pa.int64()), *((f"c{i}", pa.int64()) for i in range(categories))]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[Counter] = [Counter() for _ in range(categories + 1)]
        for text, targets in rows(batches, ["text", "targets"]):
            features = feature_counts(words_of(text)).keys()
            totals[0].update(features)
            for i, target in enumerate(targets):
                if target:
                    totals[i + 1].update(features)
        yield from batches_of(((f, n, *(t[f] for t in totals[1:])) for f, n in totals[0].items()), pa.schema(fields))

    names = [name for name, _ in fields[1:]]
    schema = "feature string, " + ", ".join(f"{name} long" for name in names)
    counts = sample.mapInArrow(count, schema).groupBy("feature").agg(*(F.sum(n).alias(n) for n in names))
    counts = cut_lineage(counts.where(F.col("n") >= LEAST_DOCUMENTS), "features")
    ones = [F.sum(F.get("targets", F.lit(i))).alias(f"c{i}") for i in range(categories)]
    totals = sample.agg(F.count("*").alias("n"), *ones).first()
    least = least_distance(counts.count())
    chosen: set[str] = set()
    for i in range(categories):
        share = (totals[f"c{i}"] or 0) / max(1, totals.n)
        if not 0 < share < 1:
            continue
        expected = F.col("n") * share
        distance = F.pow(F.col(f"c{i}") - expected, 2) / (expected * (1 - share) * (1 - F.col("n") / (totals.n + 1)))
        strong = counts.withColumn("distance", distance).where(F.col("distance") >= least)
        best = strong.orderBy(F.desc("distance"), "feature").limit(MAX_FEATURES)
        chosen.update(row.feature for row in best.select("feature").collect())
    return sorted(chosen)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


class Chain:
    """Fitted weights: for each category a bias, the features' weights, and those of
    the categories before it."""

    def __init__(self, features: list[str], links: list[tuple[float, list[float], list[float]]]):
        words = [(f, i) for i, f in enumerate(features) if not f.endswith("*")]
        starts = [(f[:-1], i) for i, f in enumerate(features) if f.endswith("*")]
        self.words = {f: tuple(weights[i] for _, weights, _ in links) for f, i in words}
        self.starts = {f: tuple(weights[i] for _, weights, _ in links) for f, i in starts}
        self.links = [(bias, earlier) for bias, _, earlier in links]

    def __call__(self, text: str | None) -> list[float]:
        words = words_of(text)
        hits = [hit for hit in map(self.words.get, words) if hit]
        hits += [hit for w in words if len(w) > BEGINNING and (hit := self.starts.get(w[:BEGINNING]))]
        scale = 100 / (len(words) + SMOOTHING)
        sums = [scale * math.fsum(part) for part in zip(*hits)] or [0.0] * len(self.links)
        found: list[float] = []
        for (bias, earlier), total in zip(self.links, sums):
            found.append(sigmoid(bias + total + math.fsum(w * p for w, p in zip(earlier, found))))
        return found


def train(sample: DataFrame, categories: Sequence[str]) -> Chain:
    """The chain fitted to ``sample(doc_id, text, targets)``."""
    features = choose_features(sample, len(categories))
    place = {feature: i for i, feature in enumerate(features)}
    width = max(1, len(features))

    @F.udf(returnType=VectorUDT(), useArrow=False)
    def shares(text: str | None):
        words = words_of(text)
        scale = 100 / (len(words) + SMOOTHING)
        counts = feature_counts(words)
        return Vectors.sparse(width, {place[f]: n * scale for f, n in counts.items() if f in place})

    @F.udf(returnType=VectorUDT(), useArrow=False)
    def extended(vector, earlier):
        values = dict(zip(vector.indices.tolist(), vector.values.tolist()))
        values.update({width + i: p for i, p in enumerate(earlier)})
        return Vectors.sparse(width + len(earlier), values)

    def predicted(bias: float, weights: list[float]):
        @F.udf(returnType="double", useArrow=False)
        def run(vector):
            return sigmoid(bias + math.fsum(weights[i] * v for i, v in zip(vector.indices.tolist(), vector.values.tolist())))

        return run

    def appended(table: DataFrame, p: Column) -> DataFrame:
        return table.select("doc_id", "targets", "fold", "shares", F.array_append("earlier", p).alias("earlier"))

    learner = LogisticRegression(maxIter=ITERATIONS, regParam=REGULARISATION)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold")
    none = F.array().cast("array<double>").alias("earlier")
    known = sample.select("doc_id", "targets", fold, shares("text").alias("shares"), none)
    known = cut_lineage(known, "shares").coalesce(TRAINING_PARTITIONS)
    links = []
    for i, _ in enumerate(categories):
        label = F.get("targets", F.lit(i)).cast("double").alias("label")
        table = known.select("*", label, extended("shares", "earlier").alias("features")).persist()
        counts = table.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect()
        n, k = sum(c.n for c in counts), sum(c.k for c in counts)
        if 0 < k < n:
            model = learner.fit(table)
            weights = model.coefficients.toArray().tolist()
            links.append((float(model.intercept), weights[:width], weights[width:]))
        else:
            links.append((_logit(k, n), [0.0] * width, [0.0] * i))
        if i + 1 < len(categories):
            parts = []
            for c in counts:
                others, held = table.where(F.col("fold") != c.fold), table.where(F.col("fold") == c.fold)
                if 0 < k - c.k < n - c.n:
                    seen = learner.fit(others)
                    p = predicted(float(seen.intercept), seen.coefficients.toArray().tolist())("features")
                else:
                    p = F.lit(sigmoid(_logit(k - c.k, n - c.n)))
                parts.append(appended(held, p))
            if parts:
                known = cut_lineage(reduce(DataFrame.union, parts), "out_of_fold").coalesce(TRAINING_PARTITIONS)
        table.unpersist()
    return Chain(features, links)


def _logit(k: float, n: float) -> float:
    """Log odds of the base rate ``(k + 1) / (n + 2)``."""
    return math.log((k + 1) / (n - k + 1))


def probabilities(text: str, chain: Chain, categories: Sequence[str]) -> Column:
    """A struct of the categories' probabilities, to six places."""
    kind = pa.struct([(c, pa.float64()) for c in categories])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [dict(zip(categories, (round(p, 6) for p in chain(t.as_py())))) for t in texts]
            yield pa.array(found, kind)

    return F.arrow_udf(run, ", ".join(f"{c} double" for c in categories))(F.col(text).cast("string"))


def fitted(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> Chain:
    return train(labelled_sample(docs, labels, categories), categories)


def judge(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``(doc_id, toxicity)`` of every row: a struct of probabilities, the last
    category's being the one that counts."""
    chain = fitted(docs, labels, categories)
    return docs.select(F.col("doc_id").cast("long"), probabilities("text", chain, categories).alias("toxicity"))


def keep_clean(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The rows of ``docs`` that the chain does not find toxic, as they are."""
    found = probabilities("text", fitted(docs, labels, categories), categories)[categories[-1]]
    return back(docs.select(whole_row(), found.alias("toxic")).where(F.col("toxic") <= LIMIT))
