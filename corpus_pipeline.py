"""From raw documents to token ids: five stages, each one operator of ``statline.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is stored as Parquet and read again for the next one.

Every stage takes any rows: an empty table gives an empty result, columns beyond those
of documents stay whatever their names (but in the last stage), and very long texts
are handled whole. What becomes of null and empty texts, ties and repeated rows is
said at each stage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.llm.common import table
from statline.llm.curriculum_mix import training_rows
from statline.llm.secret_scan import redact_secrets
from statline.llm.sentencepiece_codec import encode_and_decode
from statline.llm.simhash_dedup import one_of_each
from statline.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on these documents' labels.

    A null or empty text is scored by the bias alone, and repeated rows alike; a score of
    exactly 0.5 rejects.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group stays: fingerprints of three-word shingles link
    at 3 or fewer differing bits.

    Null and empty texts are one group. Of repeated rows one stays; rows of one id with
    other contents are told apart by a hash of these. A null id comes first.
    """
    return one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and ``n_chars`` follows.

    A null text stays null, with null ``n_chars``. Spans that overlap share a mask.
    """
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix makes over a document, in training order.

    A document that the mix takes in part is there whole. Null and empty texts have no
    words and are not taken. A null source is one of its own, the last. Documents at one
    position come in any order.
    """
    return training_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and what they decode to; null for a null text."""
    coded = encode_and_decode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_ids"), "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

ORACLE_SQL: str | None = None  # a fitted classifier and XXH64 have no SQL


def _folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors reach."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="corpus-pipeline-")
    return f"{base.rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents; each but the last is stored and read again."""
    folder = _folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
