"""Removing repeated passages with a run-length compressed Burrows-Wheeler transform.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller id. Strings do not cross documents.

Where to look. In every string of 50 bytes, one of its 27 pieces of 24 bytes has the
least hash: its anchor. Equal strings have equal anchors at equal offsets, so only
strings whose anchor occurs in two documents can repeat. Tasks exchange hashes of
anchors in packed lists, one for each batch of documents and bucket of hashes, and
learn which ones are shared.

The index. Around a shared anchor lie all strings it is the anchor of, within 76
bytes: its context. Contexts of a bucket, each different one once with the smallest
id it occurs in, make a small repetitive corpus, in which anchors stand in one column.
Its transform is built column by column from the right: contexts in the order of what
follows a column give up the byte in it, and runs of equal bytes are all that is kept
of that: a run's byte, its start, where it goes in the next order, and the contexts
sampled at its two ends. Sorting a column means sorting its runs. In a run the
match of neighbours gets one byte longer; only where runs meet are the contexts
sampled there compared. Neighbours that match for 50 bytes hold the same string: of
each such stretch the index keeps the start and the smallest id (:class:`RunIndex`).

Matching statistics. A bucket's contexts are streamed against the index, all side by
side, from their last byte to the first: inside a run of its byte a context
follows the run, elsewhere it goes on from the sampled end of the nearer run of its
byte, by comparing bytes. Where its longest match reaches 50 bytes, the stretch it
stands in tells the smallest id that has the string.

The transform is made of many small ones, as a single one over a corpus of
terabytes could only be sorted by one machine. Anchors found in very many documents
send each string on its own, to the bucket of its hash, so no bucket fills up with
one passage. Buckets get each context of a batch once, and answer with the strings of
it to remove: places of contexts never leave their batch, which finds them again when
it cuts. So a passage that is in all documents is one context a batch. Every
comparison that decides is of bytes; hashes only bring together.

Documents are dealt to batches by hash and sorted in them, so whatever is computed
again after a loss comes out the same. Equal rows, of one id and text, share a batch.

Defined results: a null text is an empty one; a null id counts as smaller than all
others; rows with the same id never remove from each other, equal rows get equal
results; texts shorter than 50 bytes are kept whole. Bytes, not characters, are
removed, so what is kept need not be valid UTF-8. An empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statline.llm.common import gathered

LENGTH, PIECE = 50, 24
OFFSETS = LENGTH - PIECE + 1  # places of an anchor in its string
CONTEXT = LENGTH + OFFSETS - 1  # bytes around an anchor that its strings cover
ROW = 80  # a context's bytes, filled up to whole words
BATCH_BYTES, BUCKET_BYTES, SLICE_BYTES = 8 << 20, 4 << 20, 1 << 19
HOT = 8192  # documents with one anchor from which on its strings go one by one
NULL_ID = -(1 << 63)
PLACE = np.uint64((1 << 24) - 1)
_random = np.random.default_rng(50)
BYTE_HASH = _random.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
WORD_HASH = _random.integers(0, 1 << 64, ROW // 8, np.uint64, endpoint=False) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _piece_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on."""
    hashes, n = {1: BYTE_HASH[text]}, 1
    while n < 16:
        power = np.uint64(pow(BASE, n, 1 << 64))
        hashes[2 * n] = hashes[n][:-n] * power + hashes[n][n:]
        n *= 2
    rest = len(text) - PIECE + 1
    return _mix(hashes[16][:rest] * np.uint64(pow(BASE, 8, 1 << 64)) + hashes[8][16 : 16 + rest])


class Anchors:
    """Anchors of all strings in some pieces of text, in order.

    ``at`` is the anchor's place, ``low`` and ``high`` those of the first and last
    string it belongs to, all in the joined text; ``piece`` the number of the piece.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        self.start = np.cumsum(sizes) - sizes
        none = np.empty(0, np.int64)
        self.at = self.low = self.high = self.piece = none
        self.hash = np.empty(0, np.uint64)
        if len(self.text) < LENGTH:
            return
        hashes = _piece_hashes(self.text)
        least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)  # ties to the left
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: 16 - OFFSETS], least[OFFSETS - 16 :])
        piece = np.repeat(np.arange(len(pieces)), sizes)
        strings = np.flatnonzero(piece[: len(least)] == piece[LENGTH - 1 :])
        if not len(strings):
            return
        at = (least[strings] & PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.at, self.low = at[first], strings[first]
        self.high = strings[np.r_[first[1:], len(at)] - 1]
        self.hash, self.piece = hashes[self.at], piece[self.at]

    def contexts(self, some: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows of bytes around the anchors ``some``, zero outside of the strings ``low`` to ``high``."""
        around = np.r_[np.zeros(OFFSETS - 1, np.uint8), self.text, np.zeros(ROW, np.uint8)]
        rows = np.lib.stride_tricks.sliding_window_view(around, ROW)[self.at[some]]
        begin = (low - self.at[some] + OFFSETS - 1)[:, None]
        end = (high - self.at[some] + OFFSETS - 1 + LENGTH)[:, None]
        column = np.arange(ROW)
        return np.where((column >= begin) & (column < end), rows, 0).astype(np.uint8)


class Batch:
    """The documents of a batch, in a fixed order, and slices of their text."""

    def __init__(self, table: pa.Table) -> None:
        ids, tags = table.column("id").to_numpy(), table.column("tag").to_numpy()
        self.order = np.lexsort((tags, ids))
        self.ids = ids[self.order]
        self.bodies = table.column("body")

    def body(self, place: int) -> bytes:
        return self.bodies[int(self.order[place])].as_py()

    def slices(self) -> Iterator[tuple[Anchors, np.ndarray, np.ndarray]]:
        """Anchors with, for each piece, its document's place and where in it the piece starts."""
        pieces, docs, starts, size = [], [], [], 0
        for place in range(len(self.order)):
            body = self.body(place)
            for at in range(0, max(1, len(body) - LENGTH + 1), SLICE_BYTES):
                piece = body[at : at + SLICE_BYTES + LENGTH - 1]
                pieces.append(piece)
                docs.append(place)
                starts.append(at)
                size += len(piece)
                if size >= SLICE_BYTES:
                    yield Anchors(pieces), np.array(docs), np.array(starts)
                    pieces, docs, starts, size = [], [], [], 0
        if pieces:
            yield Anchors(pieces), np.array(docs), np.array(starts)


def _bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket in the upper half, 32 more bits of hash in the lower one."""
    other = _mix(hashes * np.uint64(BASE))
    return ((other >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (
        other & np.uint64(0xFFFFFFFF)
    )


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each bucket in sorted keys, with a last end, and the buckets."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.empty(0, int)
    return np.r_[first, len(keys)], bucket[first]


def _anchor_lists(buckets: int):
    """Of a batch: each bucket's anchor hashes, with the number of documents (65535 at most)."""

    def run(table: pa.Table) -> pa.Table:
        batch, keys, docs = Batch(table), [], []
        for anchors, doc, _ in batch.slices():
            keys.append(_bucketed(anchors.hash, buckets))
            docs.append(doc[anchors.piece].astype(np.int32))
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        first = np.flatnonzero(new)
        fresh = new | np.r_[True, doc[1:] != doc[:-1]][: len(key)]
        many = np.minimum(np.add.reduceat(fresh, first, dtype=np.int64), 65_535) if len(key) else fresh
        key = key[first]
        ends, bucket = _split(key)
        cuts = list(zip(ends, ends[1:]))
        low, many = key.astype(np.uint32), many.astype(np.uint16)
        return pa.table({
            "bucket": pa.array(bucket, pa.int64()),
            "batch": pa.array([table.column("batch")[0].as_py()] * len(cuts), pa.int32()),
            "keys": _binary([low[a:b].tobytes() for a, b in cuts]),
            "docs": _binary([many[a:b].tobytes() for a, b in cuts]),
        })

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket: for each batch the anchors that two documents have, and which are hot."""
    parts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("docs")])
    source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    key = np.concatenate(parts)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    total = np.repeat(total, np.diff(np.r_[first, len(key)]))
    keep = total >= 2
    back = np.argsort(source[order][keep], kind="stable")
    key, hot, source = key[order][keep][back], (total[keep] >= HOT)[back], source[order][keep][back]
    bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)
    batches = table.column("batch").to_pylist()
    rows = []
    for place in np.unique(source):
        a, b = np.searchsorted(source, [place, place + 1])
        whole = key[a:b].astype(np.uint64) | bucket
        rows.append((batches[place], whole.tobytes(), hot[a:b].astype(np.uint8).tobytes()))
    return pa.table({
        "batch": pa.array([r[0] for r in rows], pa.int32()),
        "keys": _binary([r[1] for r in rows]), "hot": _binary([r[2] for r in rows]),
    })


@dataclass
class Contexts:
    """A batch's different contexts, by bucket, and where in its documents they occur."""

    bucket: np.ndarray
    rows: np.ndarray
    ids: np.ndarray  # the smallest of each
    offsets: np.ndarray  # first and last offset of the anchor in the context's strings
    # by place
    context: np.ndarray
    doc: np.ndarray
    at: np.ndarray  # of the anchor
    later: np.ndarray  # whether the document's id is larger than the context's smallest

    def cuts(self) -> list[tuple[int, int]]:
        """Where each bucket's contexts start and end."""
        edges = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1], True])
        return list(zip(edges[:-1].tolist(), edges[1:].tolist())) if len(self.bucket) else []


def _contexts(batch: Batch, shared: pa.Table, buckets: int) -> Contexts | None:
    """Contexts around the shared anchors; the same each time it is asked."""
    if not shared.num_rows:
        return None
    known = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in shared.column("keys")])
    hot = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in shared.column("hot")])
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    found = []
    for anchors, doc, start in batch.slices():
        key = _bucketed(anchors.hash, buckets)
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        some = np.flatnonzero(known[place] == key)
        many = np.where(hot[place[some]] > 0, anchors.high[some] - anchors.low[some] + 1, 1)
        # a hot anchor's strings one by one, another's all together
        alone = np.repeat(hot[place[some]] > 0, many)
        some = np.repeat(some, many)
        step = np.arange(len(some)) - np.repeat(np.cumsum(many) - many, many)
        low = np.where(alone, anchors.low[some] + step, anchors.low[some])
        high = np.where(alone, low, anchors.high[some])
        rows = anchors.contexts(some, low, high)
        words = rows.view(np.uint64)
        digest = np.zeros(len(rows), np.uint64)
        for i in range(ROW // 8):
            digest = _mix((digest ^ words[:, i]) * WORD_HASH[i])
        to = np.where(alone, _bucketed(digest, buckets), key[some]) >> np.uint64(32)
        piece = anchors.piece[some]
        shift = start[piece] - anchors.start[piece]
        offsets = np.stack([anchors.at[some] - high, anchors.at[some] - low], axis=1)
        found.append((to.astype(np.int64), digest, rows, offsets.astype(np.uint8),
                      doc[piece].astype(np.int32), (anchors.at[some] + shift).astype(np.int32)))
    to, digest, rows, offsets, doc, at = [np.concatenate(x) for x in zip(*found)]
    # equal contexts of other strings are others
    digest = _mix(digest ^ (offsets[:, 0].astype(np.uint64) << np.uint64(8) | offsets[:, 1]))
    ids = batch.ids[doc]
    order = np.lexsort((ids, digest, to))
    to, digest, doc, at, ids = to[order], digest[order], doc[order], at[order], ids[order]
    first = np.r_[True, (to[1:] != to[:-1]) | (digest[1:] != digest[:-1])][: len(order)]
    group = np.cumsum(first) - 1
    head = np.flatnonzero(first)
    odd = (rows[order] != rows[order[head[group]]]).any(axis=1) if len(order) else first
    if odd.any():  # a hash of two contexts: all of its rows on their own
        first |= np.isin(group, group[odd])
        group, head = np.cumsum(first) - 1, np.flatnonzero(first)
    return Contexts(
        bucket=to[head], rows=rows[order[head]], ids=ids[head], offsets=offsets[order[head]],
        context=group, doc=doc, at=at, later=ids > ids[head][group],
    )


def _context_lists(buckets: int):
    """Of a batch: for each bucket its different contexts."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        found = _contexts(Batch(docs), shared, buckets) if docs.num_rows else None
        if found is None:
            return LISTS.empty_table()
        codec = pa.Codec("zstd", compression_level=1)
        out = []
        for a, b in found.cuts():
            parts = [found.rows[a:b], found.ids[a:b], found.offsets[a:b]]
            raw = b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
            out.append((int(found.bucket[a]), b - a, codec.compress(raw, asbytes=True)))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([
            pa.array(columns[0], pa.int64()), pa.array([docs.column("batch")[0].as_py()] * len(out), pa.int32()),
            pa.array(columns[1], pa.int32()), _binary(list(columns[2])),
        ], schema=LISTS)

    return run


LISTS = pa.schema([("bucket", pa.int64()), ("batch", pa.int32()), ("different", pa.int32()),
                   ("packed", pa.binary())])


def _unpacked(packed: bytes, different: int) -> list[np.ndarray]:
    shapes = [(np.uint8, (different, ROW)), (np.int64, (different,)), (np.uint8, (different, 2))]
    sizes = [np.dtype(kind).itemsize * math.prod(shape) for kind, shape in shapes]
    raw = pa.Codec("zstd").decompress(packed, sum(sizes), asbytes=True)
    ends = np.cumsum(sizes)
    return [
        np.frombuffer(raw[end - size : end], kind).reshape(shape)
        for (kind, shape), size, end in zip(shapes, sizes, ends)
    ]


def _agree(a: np.ndarray, b: np.ndarray, column: int) -> np.ndarray:
    """For how many bytes from ``column`` on the rows of ``a`` and ``b`` agree."""
    differ = a[:, column:CONTEXT] != b[:, column:CONTEXT]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), CONTEXT - column)


@dataclass
class Column:
    """One column of the transform: its runs of equal bytes, in the order of what follows."""

    start: np.ndarray
    byte: np.ndarray
    to: np.ndarray  # where the run starts in the order that includes this column
    head: np.ndarray  # contexts sampled at its ends
    tail: np.ndarray
    by_byte: np.ndarray  # runs by byte, then place
    key: np.ndarray  # (byte, run) in that order, as one number
    # of the order that includes this column, where an offset belongs to it:
    stretch: np.ndarray | None  # starts of stretches that agree for LENGTH bytes
    least: np.ndarray | None  # the smallest id with a string there


NOBODY = np.iinfo(np.int64).max


def _part_of(start: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` places the part it lies in, for as long as a column is looked at."""
    return np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.r_[start, n]))


class RunIndex:
    """Run-length transform of different contexts, with samples at run ends.

    ``ids`` are the smallest id of each context; ``offsets`` (first, last) say which
    strings of a context count. What is kept grows with the runs and the stretches of
    equal strings, not with the contexts; these themselves stay for comparisons at run
    ends.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.n = n = len(rows)
        self.rows, self.columns = rows, [None] * CONTEXT
        columns = np.ascontiguousarray(rows.T)
        order, match = np.arange(n), np.zeros(n, np.int64)
        for column in range(CONTEXT - 1, -1, -1):
            transform = columns[column][order]
            start = np.flatnonzero(np.r_[True, transform[1:] != transform[:-1]])
            size = np.diff(np.r_[start, n])
            byte, head, tail = transform[start], order[start], order[start + size - 1]
            by_byte = np.argsort(byte, kind="stable")
            to = np.empty(len(start), np.int64)
            to[by_byte] = np.cumsum(size[by_byte]) - size[by_byte]
            moved = gathered(start[by_byte], size[by_byte])[0]
            order, match = order[moved], match[moved] + 1
            # where a run follows another of its byte: the contexts at the ends that meet
            match[to] = 0
            meet = by_byte[1:][byte[by_byte[1:]] == byte[by_byte[:-1]]]
            before = by_byte[:-1][byte[by_byte[1:]] == byte[by_byte[:-1]]]
            match[to[meet]] = _agree(rows[head[meet]], rows[tail[before]], column)
            stretch = least = None
            offset = OFFSETS - 1 - column
            if offset >= 0:
                mine = (offsets[order, 0] <= offset) & (offset <= offsets[order, 1])
                stretch = np.flatnonzero(match < LENGTH)
                least = np.minimum.reduceat(np.where(mine, ids[order], NOBODY), stretch)
            self.columns[column] = Column(
                start=start, byte=byte, to=to, head=head, tail=tail, by_byte=by_byte,
                key=(byte.astype(np.int64) * len(start) + np.arange(len(start)))[by_byte],
                stretch=stretch, least=least,
            )

    @property
    def size(self) -> int:
        """Runs and stretches that are kept."""
        return sum(len(c.start) + (0 if c.stretch is None else len(c.stretch)) for c in self.columns)

    def stream(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """Of any contexts, column by column from the last: (column, how far each agrees with
        the index from there on, at most, the smallest id that has the string there)."""
        at, known = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        bytes_of = np.ascontiguousarray(rows.T)
        for column in range(CONTEXT - 1, -1, -1):
            here, byte = self.columns[column], bytes_of[column]
            run = _part_of(here.start, self.n)[at]
            inside = here.byte[run] == byte
            known = np.where(inside, known + 1, 0)
            at = at + (here.to - here.start)[run]  # right inside of runs
            out = np.flatnonzero(~inside)
            if len(out):
                at[out], known[out] = self._nearest(here, column, rows[out], byte[out], run[out])
            least = None
            if here.stretch is not None:
                least = here.least[_part_of(here.stretch, self.n)[at]]
                least = np.where(known >= LENGTH, least, NOBODY)
            yield column, known, least

    def _nearest(
        self, here: Column, column: int, rows: np.ndarray, byte: np.ndarray, run: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """From places in runs of other bytes to the nearer end of a run of their byte: place
        in the next order and agreement, 0 where there is no such run."""
        runs = len(here.start)
        after = np.searchsorted(here.key, byte.astype(np.int64) * runs + run)
        last = np.r_[here.start[1:], here.start[-1] + 1]  # the last run's end does not matter below
        at, known = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for side, sample in ((after, here.head), (after - 1, here.tail)):
            there = np.clip(side, 0, runs - 1)
            other = here.by_byte[there]
            fits = (side >= 0) & (side < runs) & (here.byte[other] == byte)
            fits = np.flatnonzero(fits)
            other = other[fits]
            agree = _agree(rows[fits], self.rows[sample[other]], column)
            better = agree > known[fits]
            place = here.to[other]
            if sample is here.tail:  # a run before another one: its length is known
                place = place + last[other] - here.start[other] - 1
            at[fits[better]], known[fits[better]] = place[better], agree[better]
        return at, known


def smallest_ids(rows: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest id that has each string, by context and offset of the anchor in the string."""
    smallest = np.empty((len(rows), OFFSETS), np.int64)
    for column, _, least in RunIndex(rows, ids, offsets).stream(rows):
        if least is not None:
            smallest[:, OFFSETS - 1 - column] = least
    return smallest


def _removals(table: pa.Table) -> pa.Table:
    """Of a bucket: for each batch the offsets, as bits, of each context's strings to remove."""
    bucket, batches = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
    lists = [
        _unpacked(*[table.column(c)[i].as_py() for c in ("packed", "different")])
        for i in range(table.num_rows)
    ]
    rows = np.concatenate([x[0] for x in lists])
    ids = np.concatenate([x[1] for x in lists])
    offsets = np.concatenate([x[2] for x in lists])
    # contexts that several batches have, once, with the smallest id
    both = np.concatenate([rows, offsets], axis=1)
    key = np.ascontiguousarray(both).view(np.dtype((np.void, both.shape[1]))).ravel()
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    first, group = np.flatnonzero(new), np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], first)
    smallest = smallest_ids(rows[order[first]], least, offsets[order[first]])
    masks, at = [], 0
    for own, own_ids, own_offsets in lists:
        found = smallest[group[at : at + len(own)]]
        at += len(own)
        masks.append(_bits(_within(own_offsets) & (found < own_ids[:, None])).tobytes())
    return pa.table({
        "batch": pa.array(batches, pa.int32()), "bucket": pa.array([bucket] * len(lists), pa.int64()),
        "masks": _binary(masks),
    })


def _within(offsets: np.ndarray) -> np.ndarray:
    """Which offsets lie in each range."""
    span = np.arange(OFFSETS)
    return (span >= offsets[:, :1]) & (span <= offsets[:, 1:])


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as one number each."""
    return np.where(flags, np.uint32(1) << np.arange(OFFSETS, dtype=np.uint32), np.uint32(0)).sum(
        axis=1, dtype=np.uint32
    )


def _strings_to_remove(
    batch: Batch, told: pa.Table, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place of the anchor, offsets as bits) of a batch, by document."""
    is_answer = told.column("masks").is_valid()
    found = _contexts(batch, told.filter(pc.invert(is_answer)), buckets)
    if found is None:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint32)
    answers = told.filter(is_answer)
    by_bucket = {
        b: np.frombuffer(m.as_py(), np.uint32)
        for b, m in zip(answers.column("bucket").to_pylist(), answers.column("masks"))
    }
    parts = [by_bucket[int(found.bucket[a])] for a, _ in found.cuts()]
    gone = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    # a later document loses all strings of a context that an earlier one has
    mask = np.where(found.later, _bits(_within(found.offsets))[found.context], gone[found.context])
    keep = np.flatnonzero(mask)
    keep = keep[np.argsort(found.doc[keep], kind="stable")]
    return found.doc[keep], found.at[keep].astype(np.int64), mask[keep]


def _cut(with_kept: bool, buckets: int):
    """Of a batch: what each document loses."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        batch = Batch(docs)
        doc, place, mask = _strings_to_remove(batch, told, buckets)
        ends = np.searchsorted(doc, np.arange(len(batch.order) + 1))
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "spans", "kept_sha256", "kept")}
        for i in range(len(batch.order)):
            body = batch.body(i)
            a, b = ends[i], ends[i + 1]
            gone, spans, kept = 0, [], body
            if b > a:
                delta = np.zeros(len(body) + 1, np.int64)
                for offset in range(OFFSETS):
                    start = place[a:b][(mask[a:b] >> np.uint32(offset)) & 1 > 0] - offset
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + LENGTH, -1)
                covered = np.cumsum(delta)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.r_[False, covered, False].view(np.int8)))
                spans = [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]
                kept = np.frombuffer(body, np.uint8)[~covered].tobytes()
                gone = len(body) - len(kept)
            values = (len(body), gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None)
            for column, value in zip(out, values):
                out[column].append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = (pa.int64(), pa.int64(), span, pa.string(), pa.binary())
        columns = {c: pa.array(v, t) for (c, v), t in zip(out.items(), types)}
        return pa.table({"doc": docs.column("doc").take(pa.array(batch.order)), **columns})

    return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = False,
    batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(``key``, n_bytes, n_removed, spans, kept_sha256, kept) of each document.

    ``spans`` are the maximal removed runs in bytes, end exclusive. ``kept`` holds the
    remaining bytes if ``with_kept``, else null.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, math.ceil(total / batch_bytes))
    buckets = max(1, math.ceil(total / bucket_bytes))
    tag = F.xxhash64(key, text)
    rows = docs.select(
        F.col(key).alias("doc"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"),
        tag.alias("tag"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
        F.pmod(tag, F.lit(batches)).cast("int").alias("batch"),
    )
    anchors = rows.groupBy("batch").applyInArrow(
        _anchor_lists(buckets), "bucket long, batch int, keys binary, docs binary"
    )
    shared = anchors.groupBy("bucket").applyInArrow(_shared, "batch int, keys binary, hot binary")
    contexts = (
        rows.groupBy("batch").cogroup(shared.groupBy("batch"))
        .applyInArrow(_context_lists(buckets), "bucket long, batch int, different int, packed binary")
    )
    answers = contexts.groupBy("bucket").applyInArrow(_removals, "batch int, bucket long, masks binary")
    told = shared.unionByName(answers, allowMissingColumns=True)
    kind = docs.select(key).schema[0].dataType.simpleString()
    cut = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        _cut(with_kept, buckets),
        f"doc {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, "
        "kept_sha256 string, kept binary",
    )
    return cut.withColumnRenamed("doc", key)
