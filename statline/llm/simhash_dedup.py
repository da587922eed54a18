"""SimHash near-duplicates by an inverted index of byte positions.

Fingerprint: A-Z are lower-cased, the text falls into words and these into
shingles of three, repeats included (fewer words: one shingle of all; none: the
fingerprint is zero). Each shingle's 64-bit XXH64 votes on every bit; a bit is 1
if set in over half of them. Two fingerprints link at 3 or fewer differing bits,
and components of links are the groups.

Search: 3 bits spoil at most 3 of the 8 bytes, so linked fingerprints share at
least 5 bytes in place. Single bytes make long lists, so the index holds triples
of positions: of 5 shared positions one half of the fingerprint has at least 3,
and the 4 triples of each half cover that. Two distinct fingerprints that meet in
a list are a candidate pair; their shared bytes are tallied, pairs under 5 are
let go, and the others verified bit by bit. Copies share one fingerprint and meet
no one twice.

Long lists are cut into blocks of ``BLOCK`` fingerprints, and each pair of blocks
is a task's work. What leaves a task is not the pairs but a star for each of its
components, so a dense group of n fingerprints gives about n rows.

Defined results: a null text counts as one without words; such documents link as
any others. The group's id is its smallest key, nulls aside; repeated rows share
a group. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statline.llm.common import checkpointed, slices
from statline.llm.components import components

SHINGLE, MOST_BITS, LEAST_BYTES, BLOCK = 3, 3, 5, 4096
ROWS_AT_ONCE = 512
ONE_A_BYTE = np.uint64(0x0101010101010101)
TRIPLES = [
    triple for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for triple in combinations(half, SHINGLE)
]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII, both


def _shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends - 1).tolist())]
    return np.array(hashes, dtype="<u8")


def _majorities(words: np.ndarray) -> np.ndarray:
    """For each row of 64-bit hashes the bits set in over half of them.

    The 8 bytes of a number count one bit of each byte, for 255 hashes at a time.
    """
    k, n = words.shape
    votes = np.zeros((8, k, 8), np.int64)  # bit, row, byte
    for at in range(0, n, 255 * 32):
        part = words[:, at : at + 255 * 32]
        starts = np.arange(0, part.shape[1], 255)
        for bit in range(8):
            sums = np.add.reduceat((part >> np.uint64(bit)) & ONE_A_BYTE, starts, axis=1)
            votes[bit] += sums.view(np.uint8).reshape(k, -1, 8).sum(axis=1, dtype=np.int64)
    packed = np.packbits(2 * votes.transpose(1, 2, 0) > n, axis=2, bitorder="little")
    return packed.reshape(k, 8).view("<u8")[:, 0]


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    return int(_majorities(_shingle_hashes(text)[None, :])[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, fp): the fingerprint of each document as a signed 64-bit number."""
    docs = docs.select(F.col(key), F.col(text).alias("the text"))
    schema = T.StructType([docs.schema[0], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            found = np.array([fingerprint(v.as_py()) for v in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"]
            )

    return docs.mapInArrow(run, schema)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index of each of ``n`` nodes' component."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def _stars(list_of: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of whole sorted lists, as (fingerprint, least of its group)."""
    n = len(fps)
    last = np.searchsorted(list_of, list_of, side="right") - 1  # the last place of each list
    bytes_of = fps.view(np.uint8).reshape(-1, 8)
    root, rows, shift = np.arange(n), np.arange(n), 0
    while True:
        shift += 1
        rows = rows[rows + shift <= last[rows]]
        if not len(rows):
            break
        other = rows + shift
        shared = (bytes_of[rows] == bytes_of[other]).sum(axis=1)
        keep = (shared >= LEAST_BYTES) & (root[rows] != root[other])
        a, b = rows[keep], other[keep]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= MOST_BITS
        if near.any():
            root = _roots(np.r_[np.arange(n), a[near]], np.r_[root, b[near]], n)
    tied = root != np.arange(n)
    return fps[tied], fps[root[tied]]


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(u, v): links between different fingerprints, dense groups as stars."""
    index = distinct.select(F.col(fp).alias("fp")).select(
        "fp", F.posexplode(F.array(*[_bytes_at(t) for t in TRIPLES])).alias("triple", "bytes")
    )
    lists = index.groupBy("triple", "bytes").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j")),
    )
    work = (
        index.join(lists, ["triple", "bytes"])
        .withColumn("blocks", blocks).withColumn("mine", mine)
        .select("triple", "bytes", "fp", F.explode(pair).alias("pair"))
        .select(F.xxhash64("triple", "bytes", "pair.i", "pair.j").alias("list"), "fp")
    )
    # two lists of one hash only make candidates more; fingerprints may stand twice then
    work = work.repartition("list").sortWithinPartitions("list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_list, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def result(lists: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            u, v = _stars(lists, fps.view(np.uint64))
            return pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"]
            )

        for batch in slices(batches, 1 << 16):
            held_list = np.r_[held_list, batch.column(0).to_numpy()]
            held_fp = np.r_[held_fp, batch.column(1).to_numpy()]
            whole = np.searchsorted(held_list, held_list[-1]) if len(held_list) else 0
            if whole:
                yield result(held_list[:whole], held_fp[:whole])
                held_list, held_fp = held_list[whole:], held_fp[whole:]
        yield result(held_list, held_fp)

    return work.mapInArrow(run, "u long, v long")


def _bytes_at(places: tuple[int, ...]) -> F.Column:
    """The bytes of ``fp`` at some positions as one number."""
    mask = sum(0xFF << 8 * i for i in places)
    signed = mask - (1 << 64) if mask >= 1 << 63 else mask
    return F.col("fp").bitwiseAND(F.lit(signed).cast("long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, fingerprint as 16 hex digits, component_id: the smallest key of the group)."""
    prints = checkpointed(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key"))
    first = prints.groupBy("fp").agg(F.min("key").alias("first"))
    group_of = components(links(first)).select(F.col("u").alias("fp"), F.col("v").alias("group"))
    grouped = first.join(group_of, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    ids = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    by_fp = grouped.join(ids, "group").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with only the first document, by key, of each group of :func:`near_duplicates`.

    Of repeated rows one stays, of equal keys with different rows the one of the least
    hash; a null key comes before all others. Texts without words are one group.
    """
    columns = docs.columns
    marked = docs.withColumn("row id", F.struct(F.col(key).alias("k"), F.xxhash64(*columns).alias("h")))
    groups = near_duplicates(marked, "row id", text)
    first = groups.select(F.col("component_id").alias("kept id")).distinct()
    # no struct is null, and nulls in structs are equal
    kept = marked.join(first, F.col("`row id`") == F.col("`kept id`"), "left_semi")
    return kept.dropDuplicates(["row id"]).select(*[F.col(f"`{c}`") for c in columns])
