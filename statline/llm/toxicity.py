"""Toxicity: a counterfactually regularised classifier of whole texts.

Features are what a text's words hold: each word, and its beginnings of 4 to 6
letters, which many inflected words share. A logistic model weighs which of a few
features occur at all, so long texts have no more weight than short ones.

Counterfactuals: in each labelled text, terms for groups of people are swapped for
the next term of their list. The squared change of the text's logit is penalised,
so a term gets no weight for the company it keeps, and neutral mentions of a group
do not raise the score.

Fitting uses a sample of at most ``MAX_ROWS`` labelled documents of each class,
taken by hash of the key, and of these the ``MAX_FEATURES`` features that tell the
classes apart best. Counts of features are summed by Spark; the driver only gets
those features, and for each sampled document the few it has. The share of toxic
labels, over all labels, corrects the bias for the sample's even mix. Scoring
reads every whole text and looks up words in a memory of bounded size.

Defined results: a null text scores as an empty one, by the bias alone; documents
without a label are scored as any others; of several labels of a key one toxic
one counts; labels null or without a document are not used. With labels of one
class only, every score is the share of toxic labels (0.0 without labels). Null
keys are scored and never fitted on. Repeated rows get equal scores; an empty
table gives an empty result. Extra columns stay, but for one named like the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statline.llm.common import checkpointed, slices
from statline.llm.vocabulary import Memo

MAX_ROWS, MAX_FEATURES, LEAST_DOCS = 4000, 400, 3
ROWS_AT_ONCE = 256
HELD_OUT_OF = 5
WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)

# Interchangeable terms for groups of people.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist"),
    ("christians", "muslims", "jews", "hindus", "buddhists"),
    ("gay", "lesbian", "straight", "bisexual"), ("black", "white", "asian", "latino"),
    ("immigrant", "refugee", "native"), ("immigrants", "refugees", "natives"),
    ("frau", "mann"), ("frauen", "männer"), ("christen", "muslime", "juden"),
    ("femme", "homme"), ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)


def held_out(key: Column | str) -> Column:
    """Whether the key belongs to the fold that is never fitted on; false for null."""
    column = F.col(key) if isinstance(key, str) else key
    rest = F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(HELD_OUT_OF))
    return F.coalesce(rest == 0, F.lit(False))


def words_in(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *["^" + word[:n] for n in BEGINNINGS if len(word) >= n]]


def features_in(words: Iterable[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def swaps_of(lists: Iterable[tuple[str, ...]] = IDENTITY_TERMS) -> dict[str, str]:
    """Each identity term to the next one of its list."""
    return {a: b for terms in lists for a, b in zip(terms, terms[1:] + terms[:1])}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, present: Iterable[str]) -> float:
        """Probability of label 1 for the features present."""
        logit = self.bias + sum(self.weights[f] for f in sorted(present))
        if logit < 0:
            return math.exp(logit) / (1 + math.exp(logit))
        return 1 / (1 + math.exp(-logit))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, swapped: np.ndarray, penalty: float, ridge: float = 1.0,
    rounds: int = 30,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean log loss, ridge and counterfactual change.

    ``swapped`` holds, for each text with an identity term, the change of its
    features when the term is swapped. ``ridge`` counts once, not for each text, so few
    texts leave weights small. Newton steps, halved while they do not help.
    """
    n, k = x.shape
    ones = np.hstack([x, np.ones((n, 1))])
    fixed = ridge / n * np.eye(k + 1)
    fixed[k, k] = 1e-6
    fixed[:k, :k] += 2 * penalty / n * (swapped.T @ swapped)

    def loss(v: np.ndarray) -> float:
        z = ones @ v
        return float(np.mean(np.logaddexp(0, z) - y * z) + v @ fixed @ v / 2)

    v = np.zeros(k + 1)
    best = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ones @ v, -30, 30)))
        slope = ones.T @ (p - y) / n + fixed @ v
        curve = (ones * (p * (1 - p) / n)[:, None]).T @ ones + fixed
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(v - size * step) > best:
            size /= 2
        v = v - size * step
        before, best = best, loss(v)
        if before - best < 1e-9:
            break
    return v[:k], float(v[k])


def _labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    return (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("label key"))
        .agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    )


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, ones, zeros): sampled texts of each label with the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            counts = (Counter(), Counter())
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[y].update(features_in(words_in(text.as_py())))
            names = sorted(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string())]
            columns += [pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "ones", "zeros"])

    counted = sample.select("text", "y").mapInArrow(run, "feature string, ones long, zeros long")
    return counted.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    penalty: float = 10.0,
    terms: Iterable[tuple[str, ...]] = IDENTITY_TERMS,
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
) -> Model:
    known = checkpointed(_labelled(labels, key, label))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    ones, zeros = shares.get(1, 0), shares.get(0, 0)

    def some(y: int) -> DataFrame:
        of = known.where(F.col("y") == y)
        return of.orderBy(F.xxhash64("label key"), "label key").limit(max_rows)

    # at most max_rows of each class: small enough to broadcast, and a key may stand for many rows
    chosen = F.broadcast(some(1).unionByName(some(0)))
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        chosen, F.col("key") == F.col("label key")
    )
    sample = checkpointed(
        sample.groupBy("key", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
    seen = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not ones or not zeros or len(seen) < 2:
        share = ones / max(1, ones + zeros)
        return Model({}, math.log(share / (1 - share)) if 0 < share < 1 else math.inf * (2 * share - 1))
    p, q = [(F.col(c) + 0.5) / (seen[y] + 1) for c, y in (("ones", 1), ("zeros", 0))]
    told = p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))
    counts = _feature_counts(sample).where(F.col("ones") + F.col("zeros") >= LEAST_DOCS)
    best = counts.orderBy(told.desc(), "feature").limit(max_features).select("feature").collect()
    place = {f: i for i, f in enumerate(sorted(r["feature"] for r in best))}
    if not place:
        return Model({}, math.log(ones / zeros))
    swap = swaps_of(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            here, there = [], []
            for value in batch.column(1):
                words = words_in(value.as_py())
                twin = {swap.get(w, w) for w in words}
                for rows, these in ((here, words), (there, twin)):
                    rows.append(sorted(place[f] for f in features_in(these) if f in place))
            lists = [pa.array(rows, pa.list_(pa.int32())) for rows in (here, there)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *lists], names=["key", "y", "here", "there"]
            )

    schema = T.StructType([sample.schema["key"], T.StructField("y", T.IntegerType()),
                           *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("here", "there")]])
    rows = sample.select("key", "text", "y").mapInArrow(run, schema).orderBy("key", "y").collect()
    x = np.zeros((len(rows), len(place)), np.float64)
    for i, r in enumerate(rows):
        x[i, r["here"]] = 1
    changed = [r for r in rows if r["here"] != r["there"]]
    swapped = np.zeros((len(changed), len(place)))
    for i, r in enumerate(changed):
        swapped[i, r["there"]] += 1
        swapped[i, r["here"]] -= 1
    y = np.array([r["y"] for r in rows], np.float64)
    weights, bias = fit_logistic(x, y, swapped, penalty)
    bias += math.log(ones / zeros) - math.log(seen[1] / seen[0])
    return Model(dict(zip(sorted(place), map(float, weights))), bias)


def score_text(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability ``score`` that a text is toxic."""
    if score != text:
        docs = docs.drop(score)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        memo = Memo(lambda w: tuple(f for f in features_of(w) if f in weights), 1 << 18)
        for batch in slices(batches, ROWS_AT_ONCE):
            scores = []
            for value in batch.column(text):
                found = filter(None, map(memo.__getitem__, words_in(value.as_py())))
                scores.append(model.score({f for hits in found for f in hits}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score]
            )

    return docs.mapInArrow(run, schema)


def judge_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options: object
) -> DataFrame:
    """(``key``, held_out, score, predicted) of every document."""
    rows = docs.select(F.col(key), F.col(text).alias("the text"))
    model = fit(docs, labels, key=key, text=text, **options)
    scored = score_text(rows, model, "the text", "score")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select(F.col(key), held_out(key).alias("held_out"), "score", predicted)


def without_toxic(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options: object
) -> DataFrame:
    """``docs`` without those that the classifier rejects, columns as before."""
    model = fit(docs, labels, key=key, text=text, **options)
    scored = score_text(docs, model, text, "toxicity of the text")
    return scored.where("`toxicity of the text` < 0.5").drop("toxicity of the text")
