"""Language identification by nearest centroid.

A text becomes a vector of its letter n-grams: it is lower-cased, stretches of
other characters become one space, and every run of one to four of what is left is
counted in one of ``BUCKETS`` hashed buckets. Counts are damped to 1 + ln(count),
weighted by the inverse document frequency, and normalised to length 1.

Each language has several centroids, as texts of one language differ by kind. They
come from spherical k-means: members go to the centroid of the greatest cosine, and
a centroid is the normalised sum of its members. A text's language is that of the
centroid of the greatest cosine, and the cosine is its score. Rejection: a text
further from its centroid, in 1 - cosine, than nearly all members at fitting
were, by a margin, is marked; whoever wants no guess for such texts asks for ``und``.

Document frequencies are summed by Spark over all rows learned from. K-means is
fitted on a sample of at most ``MAX_ROWS`` texts of each language, by hash of the key;
every language is a group of its own. What tasks need is broadcast: for each
language ``CLUSTERS`` centroids of ``BUCKETS`` 4-byte numbers. More than ``MAX_LANGUAGES``
languages end the job with an error, so that this stays bounded.

Defined results: a text that is null or has no letter, and any text where nothing
could be learned, is ``und`` with score 0, and not rejected. Of equal cosines the
language first in code points wins. Rows with null text or language, or without a
letter, are not learned from. Repeated rows get equal results; an empty table gives
an empty result. Columns named like added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from statline.llm.common import checkpointed, text_slices

BUCKETS, GRAMS, CLUSTERS = 1 << 13, (1, 2, 3, 4), 4
MAX_ROWS, MAX_LANGUAGES, ROUNDS = 1000, 1000, 10
#: Rejected is what lies this much further out than the share of members below stands.
INNER_SHARE, MARGIN = 0.99, 1.5
UNDETERMINED = "und"
ROWS_AT_ONCE = 128


@cache
def _letters() -> np.ndarray:
    """Which code points are letters (Unicode categories L*)."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8).astype(bool)


def _letters_only(text: str) -> np.ndarray:
    """Code points in lower case, one space for what stands between letters and at both ends;
    empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    letter = np.r_[False, letter, False]
    points = np.where(letter, np.r_[0, points, 0], 32)
    return points[np.r_[True, letter[1:] | letter[:-1]]].astype(np.uint64)


def counts(text: str | None) -> np.ndarray | None:
    """How many n-grams of a text fall into each bucket; null without a letter."""
    points = _letters_only(text or "")
    if not len(points):
        return None
    factor, total = np.uint64(0x9E3779B97F4A7C15), np.zeros(BUCKETS, np.int64)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    hashed = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            break
        # the n-gram's hash goes on from that of its beginning
        hashed = (hashed[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * factor
        hashed ^= hashed >> np.uint64(29)
        if n in GRAMS:
            total += np.bincount(((hashed * factor) >> shift).view(np.int64), minlength=BUCKETS)
    return total


def _vectors(found: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; every row has an n-gram and every weight is above 0."""
    rows = np.stack(found).astype(np.float32)
    seen = rows > 0
    rows[seen] = 1 + np.log(rows[seen])
    rows *= idf
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _fit(vectors: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means, and the cosine each may be left at most."""
    centres = [vectors.sum(axis=0)]
    centres[0] /= np.linalg.norm(centres[0])
    nearest = vectors @ centres[0]
    while len(centres) < min(clusters, len(vectors)):
        centres.append(vectors[int(np.argmin(nearest))])  # the text furthest from all so far
        nearest = np.maximum(nearest, vectors @ centres[-1])
    matrix = np.stack(centres)
    member = None
    for _ in range(ROUNDS):
        now = np.argmax(vectors @ matrix.T, axis=1)
        if member is not None and (now == member).all():
            break
        member = now
        for c in range(len(matrix)):
            total = vectors[member == c].sum(axis=0)
            if total.any():
                matrix[c] = total / np.linalg.norm(total)
    cosine = vectors @ matrix.T
    member, best = np.argmax(cosine, axis=1), cosine.max(axis=1)
    far = np.quantile(1 - best, INNER_SHARE)  # of the language, for clusters of few
    reach = [
        max(far, np.quantile(1 - best[member == c], INNER_SHARE) if (member == c).any() else 0)
        for c in range(len(matrix))
    ]
    return matrix, np.array(reach, np.float32) * MARGIN


@dataclass(frozen=True)
class Model:
    """Weights of buckets; centroids, their languages and their reaches, by language."""

    idf: np.ndarray
    centres: np.ndarray
    languages: tuple[str, ...]
    reach: np.ndarray

    def judge(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, cosine, and whether it is too far, of each row of counts."""
        vectors = _vectors(found, self.idf)
        best = np.argmax(vectors @ self.centres.T, axis=1)
        # again for the best, row by row, so that a score does not depend on a row's company
        score = np.clip((vectors * self.centres[best]).sum(axis=1, dtype=np.float64), 0, 1)
        return best, score, 1 - score > self.reach[best]


def _frequencies(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n): in how many of the texts of (lang, text) a bucket is met; bucket -1
    counts the texts. A task gives one row for each bucket and language at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = counts(text.as_py())
                if found is not None:
                    total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    total[:-1] += found > 0
                    total[-1] += 1
        for lang, total in totals.items():
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(met), pa.string()),
                    pa.array(np.where(met == BUCKETS, -1, met), pa.int32()),
                    pa.array(total[met], pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _sample(rows: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """At most ``most`` rows of each language, those of the least hashes of (key, lang, text).

    A first bound on the hash lets twice as many pass as are wanted, so the exact
    choice that follows only sees these. Of many equal rows any may stay.
    """
    spread = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    shares = [F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 2 * most / n))]
    share = F.element_at(F.create_map(*shares), F.col("lang"))
    near = rows.where(spread < share * (1 << 30)).select("lang", "text", spread.alias("h"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    return near.withColumn("rank", first).where(F.col("rank") <= most).select("lang", "text", "h")


def learn(
    rows: DataFrame, most: int = MAX_ROWS, clusters: int = CLUSTERS
) -> Model | None:
    """The model of rows of (key, lang, text); none if no text with a letter has a language."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    frequency = checkpointed(_frequencies(rows))
    sizes = {
        r["lang"]: r["n"]
        for r in frequency.where("bucket = -1").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    }
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    met = frequency.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    texts = np.zeros(BUCKETS)
    texts[[r["bucket"] for r in met]] = [r["n"] for r in met]
    idf = (np.log((1 + sum(sizes.values())) / (1 + texts)) + 1).astype(np.float32)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        # in an order of its own, for sums that agree from run to run
        texts = group.sort_values(["h", "text"])["text"]
        found = [c for c in map(counts, texts) if c is not None]
        if not found:
            return pd.DataFrame({"lang": [], "n": [], "centre": [], "reach": []})
        centres, reach = _fit(_vectors(found, idf), clusters)
        return pd.DataFrame(
            {
                "lang": group["lang"].iloc[0], "n": range(len(centres)),
                "centre": [c.astype("<f4").tobytes() for c in centres], "reach": reach,
            }
        )

    fitted = (
        _sample(rows, sizes, most).groupBy("lang")
        .applyInPandas(fit, "lang string, n int, centre binary, reach float")
        .orderBy(F.col("lang").cast("binary"), "n").collect()
    )
    if not fitted:
        return None
    return Model(
        idf=idf,
        centres=np.stack([np.frombuffer(r["centre"], "<f4") for r in fitted]),
        languages=tuple(r["lang"] for r in fitted),
        reach=np.array([r["reach"] for r in fitted], np.float32),
    )


def predict(
    docs: DataFrame, model: Model | None, text: str = "text", undetermined_if_rejected: bool = False
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``."""
    added = ["lang_pred", "score", "rejected"]
    docs = docs.drop(*[c for c in added if c != text])
    kinds = [T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)])
    # Spark broadcasts what is large in a function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, ROWS_AT_ONCE):
            found = [counts(v.as_py()) if model else None for v in batch.column(text)]
            known = [n for n, c in enumerate(found) if c is not None]
            languages = [UNDETERMINED] * batch.num_rows
            scores, rejected = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if known:
                best, scores[known], rejected[known] = model.judge([found[n] for n in known])
                for n, centre in zip(known, best.tolist()):
                    if not (undetermined_if_rejected and rejected[n]):
                        languages[n] = model.languages[centre]
            columns = [pa.array(languages, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *added]
            )

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id", of: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept from learning: by the CRC-32 of its key as text; not with a null key."""
    rest = F.crc32(F.col(key).cast("string").cast("binary")) % of
    return F.coalesce(rest == remainder, F.lit(False))


def identify_languages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    undetermined_if_rejected: bool = False,
) -> DataFrame:
    """(``key``, held_out, lang_pred, score, rejected) of every row of ``docs``, by a model
    learned from the languages of those not held out."""
    rows = docs.select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"),
        held_out(key).alias("held_out"),
    )
    model = learn(rows.where("NOT held_out"))
    judged = predict(rows.select("key", "held_out", "text"), model, "text", undetermined_if_rejected)
    return judged.select(F.col("key").alias(key), "held_out", "lang_pred", "score", "rejected")
