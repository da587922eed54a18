"""A SentencePiece model's pieces and scores, read as a unigram vocabulary.

The path of the model file is a parameter everywhere. The file is read by the
driver alone; what tasks need is broadcast and has the size of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from statline.llm.common import bytes_of, column_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a space in pieces
UNKNOWN_PENALTY = 10.0  # below the lowest score, as the public tokenizer sets it
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that text can match, with ids and scores; ids of byte pieces by value."""

    pieces: dict[str, tuple[int, float]]
    by_id: tuple[bytes, ...]  # what each id stands for in UTF-8, marks still in place
    bytes_ids: tuple[int, ...]  # empty without byte fallback
    unknown_id: int
    unknown_score: float
    dummy_prefix: bool
    by_word: bool  # no piece goes on after a mark that follows something else
    by_line: bool  # nor is there a line end in any


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models that keep text as it is, but for space marks")
    normal = [p.score for p in model.pieces if p.type == NORMAL]
    pieces, by_id, byte_ids = {}, [], {}
    for i, p in enumerate(model.pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            by_id.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type in (NORMAL, USER_DEFINED):
            # a piece of the user's outweighs whatever else covers its bytes
            n = len(p.piece.encode())
            score = p.score if p.type == NORMAL else n * max(normal) - 0.1
            pieces[p.piece] = (i, score)
            by_id.append(p.piece.encode())
        else:
            by_id.append(b"" if p.type != UNKNOWN else " ⁇ ".encode())
    fallback = model.trainer_spec.byte_fallback
    return Vocabulary(
        pieces=pieces,
        by_id=tuple(by_id),
        bytes_ids=tuple(byte_ids[b] for b in range(256)) if fallback else (),
        unknown_id=next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), 0),
        unknown_score=min(normal) - UNKNOWN_PENALTY,
        dummy_prefix=spec.add_dummy_prefix,
        by_word=(by_word := not any(MARK in p.lstrip(MARK) for p in pieces)),
        by_line=by_word and not any("\n" in p for p in pieces),
    )


V = TypeVar("V")


class Memo(dict, Generic[V]):
    """Results by word, at most ``limit`` of them: full, it starts again."""

    def __init__(self, of: Callable[[str], V], limit: int = 1 << 17) -> None:
        self.of, self.limit = of, limit

    def __missing__(self, word: str) -> V:
        value = self.of(word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def words_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """``text`` with marks for spaces, cut where no piece can span.

    The best segmentation of the whole is that of the parts put together. Line
    ends, which no piece holds, are parts of their own.
    """
    if not text:
        return []
    if vocabulary.dummy_prefix:
        text = " " + text
    if not vocabulary.by_word:
        return [text.replace(" ", MARK)]
    lines = text.split("\n") if vocabulary.by_line else [text]
    words: list[str] = []
    for n, line in enumerate(lines):
        if n:
            words.append("\n")
        parts = line.replace(" ", MARK).split(MARK)  # a mark in the text is a space, too
        # before every part but the first stands a mark; empty parts lengthen the next one's
        if parts[0]:
            words.append(parts[0])
        marks = 0
        for part in parts[1:]:
            marks += 1
            if part:
                words.append(MARK * marks + part)
                marks = 0
        if marks:
            words.append(MARK * marks)
    return words


def distinct_words(
    texts: pa.Array, vocabulary: Vocabulary
) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a whole column, as :func:`words_of` cuts them, each different one once.

    Returns these; the number of each word of the column among them; and where each
    text starts among the words. Nulls have none.
    """
    spaced = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    if vocabulary.dummy_prefix:
        space, nothing = (pa.scalar(c, pa.large_string()) for c in (" ", ""))
        prefixed = pc.binary_join_element_wise(space, spaced, nothing)
        spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 0), spaced, prefixed)
    data, starts = bytes_of(spaced)
    opens = np.zeros(len(data), bool)
    opens[starts[:-1][np.diff(starts) > 0]] = True
    if vocabulary.by_word and len(data):
        space = data == ord(" ")
        opens[1:] |= space[1:] & ~space[:-1]
        if vocabulary.by_line:
            line_end = data == ord("\n")
            opens |= line_end
            opens[1:] |= line_end[:-1]
    begin = np.flatnonzero(opens)
    coded = column_of(data, np.append(begin, len(data))).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    words = pc.replace_substring(coded.dictionary.cast(pa.large_string()), " ", MARK)
    return words, numbers, np.searchsorted(begin, starts)
