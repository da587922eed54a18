"""Token counts without tokens: a Viterbi pass that carries scores and counts only.

An Aho-Corasick automaton of the unigram vocabulary enumerates every piece that
ends at each character. Dynamic programming keeps, for each character, the best
score of a segmentation up to it and the number of its pieces. Ties go as in the
public tokenizer: a later candidate must score strictly higher, and candidates
come by the start of their last piece, so the longest last piece stays. A
character that is no piece of its own may be unknown, at the vocabulary's lowest
score less 10, and counts as one token for each of its UTF-8 bytes if the
vocabulary falls back on bytes, else as one.

Scores are added in double precision. The public tokenizer adds in single
precision, so on texts whose scores pass 2**24, such as texts with unknown
characters under this vocabulary, its own rounding can make it choose otherwise.

A text is cut where no piece can span, and counts of words are remembered up to
a limit, so memory does not grow with the text or the corpus.

A null text counts 0 tokens, like an empty one; repeated rows are counted each;
an empty table gives an empty result. Input columns are kept, but for ones named
like the two that are added, which these replace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from statline.llm.common import slices
from statline.llm.vocabulary import MODEL, Memo, Vocabulary, load, words_of

ROWS_AT_ONCE = 256


def counter(vocabulary: Vocabulary) -> Callable[[str], tuple[float, int]]:
    """A function from a word to its best score and the number of pieces."""
    automaton = ahocorasick.Automaton()
    for piece, (_, score) in vocabulary.pieces.items():
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown, fallback = vocabulary.unknown_score, bool(vocabulary.bytes_ids)
    nothing = float("-inf")

    def best(word: str) -> tuple[float, int]:
        n = len(word)
        scores, counts = [nothing] * (n + 1), [0] * (n + 1)
        scores[0] = 0.0
        closed = 0  # characters whose best is settled

        def close(upto: int) -> None:
            nonlocal closed
            while closed < upto:
                if not single[closed] and scores[closed] + unknown > scores[closed + 1]:
                    scores[closed + 1] = scores[closed] + unknown
                    width = len(word[closed].encode("utf-8", "surrogatepass")) if fallback else 1
                    counts[closed + 1] = counts[closed] + width
                closed += 1

        single = bytearray(n)
        for end, (length, score) in automaton.iter(word):  # the longest first at each end
            if closed < end:
                close(end)
            start = end + 1 - length
            if length == 1:
                single[end] = 1
            score += scores[start]
            if score > scores[end + 1]:
                scores[end + 1] = score
                counts[end + 1] = counts[start] + 1
        close(n)
        return scores[n], counts[n]

    return best


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``score`` (double), the best segmentation's."""
    added = ["n_tokens", "score"]
    docs = docs.drop(*[c for c in added if c != text])
    voc = load(model)  # Spark broadcasts what is large in a function
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(counter(voc), 1 << 18)
        for batch in slices(batches, ROWS_AT_ONCE):
            totals, scores = [], []
            for value in batch.column(text):
                found = [memo[w] for w in words_of(value.as_py() or "", voc)]
                totals.append(sum(c for _, c in found))
                scores.append(sum((s for s, _ in found), 0.0))
            columns = [*batch.columns, pa.array(totals, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)
