"""SentencePiece encoding and decoding: Viterbi over a double-array trie.

The trie of the pieces' UTF-8 bytes lies in two arrays: the child of node ``s``
by byte ``b`` is ``base[s] + b + 1`` if ``check`` names ``s`` there. From every
character the walk down the trie meets all pieces that start with it, and the
best segmentation up to each place is kept with the place its last piece starts
at. Ties, unknown characters and precision are those of ``token_count``; unknown
characters become byte pieces, or the unknown id without byte fallback.

Encoding puts one mark before a text that is not empty (if the model says so) and
marks for spaces. Decoding joins the pieces, turns marks into spaces and takes
the first space away again. It restores every text but one with U+2581, the mark
itself, in it, which comes back as a space.

A null text encodes to null, an empty one to no ids; null ids decode to null, and
a null among ids to nothing;
repeated rows are handled each; an empty table gives an empty result. Input
columns are kept, but for one named like the added column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from statline.llm.common import bytes_of, column_of, gathered, text_slices
from statline.llm.vocabulary import MARK, MODEL, Vocabulary, distinct_words, load, words_of

TEXT_AT_ONCE, IDS_AT_ONCE = 1 << 20, 1 << 18  # bytes, ids: of whole rows
LONGEST, AT_ONCE = 64, 1 << 16  # bytes of a word, and of words, that are looked at side by side


class DoubleArrayTrie:
    """Byte strings to numbers, in three flat arrays."""

    def __init__(self, words: dict[bytes, int]) -> None:
        size = 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        keys = sorted(words)
        free = 1  # where the search for gaps starts
        work = [(0, 0, len(keys), 0)]  # node, its keys from, to, depth
        while work:
            node, lo, hi, depth = work.pop()
            if len(keys[lo]) == depth:
                self.value[node] = words[keys[lo]]
                lo += 1
            children = []
            while lo < hi:
                byte, first = keys[lo][depth], lo
                while lo < hi and keys[lo][depth] == byte:
                    lo += 1
                children.append((byte, first, lo))
            if not children:
                continue
            first_byte = children[0][0]
            slot, tried = free, 0
            while True:
                self._grow(slot + 257)
                base = slot - first_byte - 1
                if base >= 0 and all(self.check[base + b + 1] < 0 for b, _, _ in children):
                    break
                slot += 1
                tried += 1
            if tried > 32:  # crowded there: leave its last gaps
                free = max(free, slot - 16)
            self.base[node] = base
            for byte, first, last in children:
                self.check[base + byte + 1] = node
                work.append((base + byte + 1, first, last, depth + 1))
        self.base, self.check, self.value = (
            np.array(a, np.int32) for a in (self.base, self.check, self.value)
        )

    def _grow(self, size: int) -> None:
        while len(self.check) <= size:
            for array, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                array.extend([fill] * len(array))

    def get(self, word: bytes) -> int:
        node = 0
        for byte in word:
            child = self.base[node] + byte + 1
            if child >= len(self.check) or self.check[child] != node:
                return -1
            node = child
        return self.value[node]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        ranked = list(vocabulary.pieces.items())
        self.scores = np.array([score for _, (_, score) in ranked])
        self.ids = np.array([i for _, (i, _) in ranked], np.int32)
        self.trie = DoubleArrayTrie({p.encode(): n for n, (p, _) in enumerate(ranked)})
        self.blob = np.frombuffer(b"".join(vocabulary.by_id), np.uint8)
        self.lengths = np.array([len(b) for b in vocabulary.by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @cached_property
    def _lists(self) -> tuple[list, ...]:
        """Arrays as lists, faster for one look at a time."""
        trie = self.trie
        return tuple(a.tolist() for a in (trie.base, trie.check, trie.value, self.scores))

    def encode_word(self, word: str) -> bytes:
        """Ids of the best segmentation, as 32-bit integers."""
        return self.encode_bytes(word.encode("utf-8", "surrogatepass"))

    def encode_bytes(self, text: bytes) -> bytes:
        """The same of a word in UTF-8."""
        n = len(text)
        base, check, value, scores = self._lists
        nothing, unknown = float("-inf"), self.vocabulary.unknown_score
        best, last, start_of = [nothing] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        start = 0
        while start < n:
            lead = text[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, single = best[start], 0, False
            for at in range(start, n):
                child = base[node] + text[at] + 1
                if check[child] != node:
                    break
                node = child
                piece = value[node]
                if piece >= 0:
                    score = here + scores[piece]
                    if score > best[at + 1]:
                        best[at + 1], last[at + 1], start_of[at + 1] = score, piece, start
                    single = single or at + 1 - start == width
            end = start + width
            if not single and here + unknown > best[end]:
                best[end], last[end], start_of[end] = here + unknown, -1, start
            start = end
        found: list[int] = []
        end = n
        while end:
            start = start_of[end]
            if last[end] >= 0:
                found.append(int(self.ids[last[end]]))
            elif self.vocabulary.bytes_ids:
                found += [self.vocabulary.bytes_ids[b] for b in reversed(text[start:end])]
            else:
                found.append(self.vocabulary.unknown_id)
            end = start
        return np.array(found[::-1], dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        coded = map(self.encode_word, words_of(text, self.vocabulary))
        return np.frombuffer(b"".join(coded), dtype=np.int32)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one after the other, and how many each word has.

        The same pass as :meth:`encode_bytes`, over all words at once: from all
        characters the trie is walked side by side, then the candidates that start at
        the first byte of any word are weighed, those at the second, and so on. No two
        of a kind reach the same place, so there are no ties among them. A word of over
        ``LONGEST`` bytes goes alone.
        """
        data, starts = bytes_of(words)
        sizes = np.diff(starts)
        short = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        # some at a time: what a word needs on the way is a hundred times its size
        parts = np.searchsorted(np.cumsum(sizes[short]), np.arange(AT_ONCE, sizes[short].sum(), AT_ONCE))
        found = [
            self._best_ids(data[gathered(starts[part], sizes[part])[0]], sizes[part])
            for part in np.split(short, parts)
        ]
        ids, counts = (np.concatenate(part) for part in zip(*found))
        every = np.zeros(len(sizes), np.int64)
        every[short] = counts
        alone = {n: data[starts[n] : starts[n + 1]].tobytes() for n in np.flatnonzero(sizes > LONGEST)}
        alone = {n: np.frombuffer(self.encode_bytes(word), np.int32) for n, word in alone.items()}
        for n, found in alone.items():
            every[n] = len(found)
        if not alone:
            return ids, every
        begin = np.cumsum(every) - every
        flat = np.empty(int(every.sum()), np.int32)
        flat[gathered(begin[short], counts)[0]] = ids
        for n, found in alone.items():
            flat[begin[n] : begin[n] + len(found)] = found
        return flat, every

    def _best_ids(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_words`, of words of 1 to ``LONGEST`` bytes side by side in ``data``."""
        trie, nothing = self.trie, float("-inf")
        last_of = np.cumsum(sizes)
        first = np.repeat(last_of - sizes, sizes)
        at = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)  # where characters start
        width = np.diff(np.append(at, len(data)))

        # all pieces from all characters
        known = np.zeros(len(at), bool)  # characters that are pieces
        found: list[tuple[np.ndarray, ...]] = []
        live, node, depth = np.arange(len(at)), np.zeros(len(at), np.int32), 0
        left = np.repeat(last_of, sizes)[at] - at  # bytes to the word's end
        while len(live):
            child = trie.base[node] + data[at[live] + depth] + 1
            inside = trie.check[child] == node
            live, node = live[inside], child[inside]
            depth += 1
            piece = trie.value[node]
            hit = piece >= 0
            ends = live[hit]
            found.append((at[ends], np.full(len(ends), depth, np.int32), piece[hit]))
            known[ends[width[ends] == depth]] = True
            more = left[live] > depth
            live, node = live[more], node[more]
        strange = np.flatnonzero(~known)
        found.append((at[strange], width[strange].astype(np.int32), np.full(len(strange), -1, np.int32)))
        start, length, piece = (np.concatenate(part) for part in zip(*found))
        gain = np.where(piece >= 0, self.scores[piece], self.vocabulary.unknown_score)

        # the best way to each place, starts in rising order within every word
        level = (start - first[start]).astype(np.uint8)
        order = np.argsort(level, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(level, minlength=LONGEST))))
        start, end, piece, gain = start[order], (start + length)[order], piece[order], gain[order]
        # a word's place 0 is its predecessor's end: place p of word w is at p + w
        shift = np.repeat(np.arange(len(sizes)), sizes)[start] if len(start) else start
        place, target = start + shift, end + shift
        best = np.full(len(data) + len(sizes), nothing)
        best[last_of - sizes + np.arange(len(sizes))] = 0.0
        chosen = np.zeros(len(best), np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            score = best[place[a:b]] + gain[a:b]
            better = np.flatnonzero(score > best[target[a:b]])
            best[target[a:b][better]] = score[better]
            chosen[target[a:b][better]] = a + better

        # back from every word's end; the segments found lie in the words' order by start
        parts = []
        now = last_of + np.arange(len(sizes))
        floor = now - sizes
        while len(now):
            parts.append(chosen[now])
            now = place[parts[-1]]
            open_ = now > floor
            now, floor = now[open_], floor[open_]
        taken = np.concatenate(parts) if parts else np.empty(0, np.int64)
        taken = taken[np.argsort(start[taken], kind="stable")]
        as_bytes = (piece[taken] < 0) & bool(self.vocabulary.bytes_ids)
        copies = np.where(as_bytes, end[taken] - start[taken], 1)
        source, begin = gathered(start[taken], copies)
        ids = np.repeat(np.where(piece[taken] >= 0, self.ids[piece[taken]], self.vocabulary.unknown_id), copies)
        if as_bytes.any():
            spelt = np.repeat(as_bytes, copies)
            ids[spelt] = np.array(self.vocabulary.bytes_ids, np.int32)[data[source[spelt]]]
        word = shift[taken]
        return ids.astype(np.int32), np.bincount(word, weights=copies, minlength=len(sizes)).astype(np.int64)

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text. Every different word of the column is looked at once."""
        words, numbers, first = distinct_words(texts, self.vocabulary)
        table, lengths = self.encode_words(words)
        places, starts = gathered((np.cumsum(lengths) - lengths)[numbers], lengths[numbers])
        missing = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
        offsets = pa.array(starts[first], pa.int32(), mask=missing)
        return pa.ListArray.from_arrays(offsets, pa.array(table[places]))

    def decode(self, ids: list[int]) -> str:
        joined = b"".join(map(self.vocabulary.by_id.__getitem__, ids))
        text = joined.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.vocabulary.dummy_prefix and text.startswith(" ") else text

    def decode_column(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids: their bytes side by side, as one array."""
        ids, bounds = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
        bounds = np.concatenate(([0], np.cumsum(bounds, dtype=np.int64)))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        if ((ids < 0) | (ids >= len(self.lengths))).any():
            raise ValueError("ids must be of the model")
        places, starts = gathered(self.starts[ids], np.where(known, self.lengths[ids], 0))
        joined = column_of(self.blob[places], starts[bounds])
        try:
            texts = joined.cast(pa.large_string())
        except pa.ArrowInvalid:  # byte pieces that are no characters
            texts = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.large_string())
        texts = pc.replace_substring(texts, MARK, " ")
        if self.vocabulary.dummy_prefix:
            texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        nothing = pa.scalar(None, pa.large_string())
        return pc.if_else(lists.is_null(), nothing, texts).cast(pa.string())


def _mapped(
    docs: DataFrame, source: str, added: dict[str, T.DataType], model: str, size: int,
    make: Callable[[Codec], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    codec = Codec(load(model))  # Spark broadcasts what is large in a function
    docs = docs.drop(*[name for name in added if name != source])
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, added, added.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make(codec)
        for batch in text_slices(batches, source, 4096, size):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns(batch.column(source))], names=[*batch.schema.names, *added]
            )

    return docs.mapInArrow(run, schema)


IDS = T.ArrayType(T.IntegerType())


def encode_text(
    docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL
) -> DataFrame:
    """``docs`` with the array ``ids`` of piece ids of ``text``."""
    return _mapped(
        docs, text, {ids: IDS}, model, TEXT_AT_ONCE, lambda codec: lambda c: [codec.encode_column(c)]
    )


def decode_ids(
    docs: DataFrame, ids: str = "ids", decoded: str = "decoded", model: str = MODEL
) -> DataFrame:
    """``docs`` with the string ``decoded`` of the ids; ids must be of the model."""
    return _mapped(
        docs, ids, {decoded: T.StringType()}, model, IDS_AT_ONCE,
        lambda codec: lambda c: [codec.decode_column(c)],
    )


def encode_and_decode(
    docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", model: str = MODEL
) -> DataFrame:
    """As :func:`encode_text`, then :func:`decode_ids`, with one way to Python and back."""

    def make(codec: Codec) -> Callable[[pa.Array], list[pa.Array]]:
        def columns(texts: pa.Array) -> list[pa.Array]:
            coded = codec.encode_column(texts)
            return [coded, codec.decode_column(coded)]

        return columns

    added = {ids: IDS, decoded: T.StringType()}
    return _mapped(docs, text, added, model, TEXT_AT_ONCE, make)
