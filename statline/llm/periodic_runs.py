"""Periodic run detection: a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q, at least 24 words
and three periods long, that no neighbouring word extends keeping the period.

The words of a text are appended one by one to a suffix automaton, whose suffix
links make a tree. Every state knows where its strings occurred last, by the colour
of its segment of a path: link-cut access from the state of the newest prefix up to
the root walks the segments, then makes the path one segment of a new colour. A
segment met on the way whose deepest state has strings of up to L words, seen last
at distance d from here, tells that the last L words also end d words earlier. With
d at most L these are a square of period d, and its length d has no smaller period,
as that would make a nearer occurrence the last. The square reaches L words further
back from its first half's end; compared word by word to the right it becomes a run.
All runs are found in that way, as each of them begins with a square.

Most texts hold no run, and to spare them the automaton, words that can be part of
none are ruled out first. In a run every word lies in 16 words in a row that stand
again at most a period before or after (a run is at least 16 words longer than its
period, and its ends overlap). Rolling hashes of 16 words bring equal ones together; words
covered by none with a near equal one are left out, again and again with the bound
on distances that the stretch left over sets: a third of its length. Equal words
have equal hashes, so no run is lost; collisions only leave more to the automaton.
A stretch is maximal, so its runs are the text's.

Work grows with n log n of a stretch. Memory of a task holds a slice of texts, and the
automaton of one stretch of one text.

Defined results: a null text has no words; repeated rows are handled each; an empty
table gives an empty result. Columns named like added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statline.llm.common import WORD, text_slices

LEAST_WORDS, LEAST_PERIODS = 24, 3
RUN = T.StructType(
    [T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")]
)


class SuffixAutomaton:
    """All substrings of a sequence of small numbers; ``prefixes`` are the states of prefixes."""

    def __init__(self, items: list[int]) -> None:
        n = len(items)
        size = 2 * n + 2
        self.link, self.length = [0] * size, [0] * size
        edges: list[dict[int, int] | None] = [None] * size
        edges[1] = {}
        link, length = self.link, self.length
        last, states, self.prefixes = 1, 1, []
        for item in items:
            states += 1
            now = states
            length[now] = length[last] + 1
            edges[now] = {}
            at = last
            while at and item not in edges[at]:
                edges[at][item] = now
                at = link[at]
            if not at:
                link[now] = 1
            else:
                to = edges[at][item]
                if length[to] == length[at] + 1:
                    link[now] = to
                else:
                    states += 1
                    copy = states
                    length[copy] = length[at] + 1
                    edges[copy] = edges[to].copy()
                    link[copy] = link[to]
                    link[to] = link[now] = copy
                    while at and edges[at].get(item) == to:
                        edges[at][item] = copy
                        at = link[at]
            last = now
            self.prefixes.append(now)
        self.states = states


class LastSeen:
    """The tree of suffix links cut into coloured paths, each one splay tree by depth.

    A path's colour is the end of its strings' last occurrence, kept at the splay
    tree's root; 0 stands for none yet.
    """

    def __init__(self, automaton: SuffixAutomaton) -> None:
        size = automaton.states + 1
        self.up = automaton.link[:size]  # splay parent, or the path's parent at a root
        self.left, self.right = [0] * size, [0] * size
        self.colour = [0] * size

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while (y := up[top]) and (left[y] == top or right[y] == top):
            top = y
        if top == x:
            return
        self.colour[x] = self.colour[top]
        above = up[top]
        while (y := up[x]) != above:
            z = up[y]
            if z != above:
                if (left[z] == y) == (left[y] == x):
                    self._rotate(y, z, above)
                else:
                    self._rotate(x, y, above)
                    y = up[x]
            self._rotate(x, y, above)

    def _rotate(self, x: int, y: int, above: int) -> None:
        """``x`` takes the place of its parent ``y``."""
        up, left, right = self.up, self.left, self.right
        z = up[y]
        if left[y] == x:
            child = left[y] = right[x]
            right[x] = y
        else:
            child = right[y] = left[x]
            left[x] = y
        if child:
            up[child] = y
        if z != above:
            if left[z] == y:
                left[z] = x
            else:
                right[z] = x
        up[x], up[y] = z, x

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Segments from ``state`` to the root, as (deepest state, colour); all become one of ``end``."""
        met = []
        up, right, colour = self.up, self.right, self.colour
        below, x = 0, state
        while x:
            self._splay(x)
            if colour[x]:
                met.append((x, colour[x]))
            if cut := right[x]:
                colour[cut] = colour[x]
            right[x] = below
            below, x = x, up[x]
        self._splay(state)
        colour[state] = end
        return met


def runs_of(items: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of two periods and more of a sequence of numbers."""
    n = len(items)
    automaton = SuffixAutomaton(items)
    seen, length = LastSeen(automaton), automaton.length
    closed: dict[int, int] = {}  # by period, where its latest run ends
    found = []
    for end, state in enumerate(automaton.prefixes, 1):
        for deepest, before in seen.access(state, end):
            period, common = end - before, length[deepest]
            if common < period or closed.get(period, 0) >= end:
                continue
            stop = end
            while stop < n and items[stop] == items[stop - period]:
                stop += 1
            closed[period] = stop
            start = before - common
            found.append((start, stop - start, period))
    return found


def _near_equal(grams: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the grams at rising places equal their next equal one, or the one before,
    no further away than ``most`` of either."""
    order = np.argsort(grams, kind="stable")
    a, b = order[:-1], order[1:]
    near = (grams[a] == grams[b]) & (place[b] - place[a] <= np.minimum(most[a], most[b]))
    held = np.zeros(len(grams), bool)
    held[a[near]] = held[b[near]] = True
    return held


def stretches(hashes: np.ndarray, text_of: np.ndarray, least: int, periods: int) -> np.ndarray:
    """(from, to) of the stretches of words, each within one text, that can hold a run."""
    # with a period q a run is max(least, periods * q) words: so many more than q at least
    gram = min(q_rest for q in range(1, least + 1) if (q_rest := max(least, periods * q) - q))
    words = len(hashes)
    if words < least:
        return np.empty((0, 2), np.int64)
    grams, factor, width = hashes.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15), 1
    rest = gram
    total, covered, power = None, 0, factor
    # a polynomial over `gram` words from those over powers of two
    scale = np.uint64(1)
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = grams[covered:] * scale
                total = part if total is None else total[: len(part)] + part[: len(total)]
                covered += width
                for _ in range(width):
                    scale = scale * factor
            rest >>= 1
            if rest:
                grams = grams[: len(grams) - width] + grams[width:] * power
                power, width = power * power, 2 * width
        total = total[: words - gram + 1]
        inside = np.flatnonzero(text_of[: len(total)] == text_of[gram - 1 :])
        # texts are told apart, too
        keys = total[inside] ^ (text_of[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    sizes = np.bincount(text_of)
    most = sizes[text_of[inside]] // periods
    while True:
        held = _near_equal(keys, inside, most)
        keys, inside = keys[held], inside[held]
        cover = np.zeros(words + 1, np.int64)
        np.add.at(cover, inside, 1)
        np.add.at(cover, inside + gram, -1)
        covered_now = np.cumsum(cover[:-1]) > 0
        # a change of text ends a stretch as well
        opened = covered_now & np.r_[True, ~covered_now[:-1] | (text_of[1:] != text_of[:-1])]
        number = np.cumsum(opened) - 1
        lengths = np.bincount(number[covered_now], minlength=int(opened.sum()))
        mine = lengths[number[inside]] if len(inside) else np.empty(0, np.int64)
        limit = np.where(mine >= least, mine // periods, 0)
        if held.all() and (len(limit) == 0 or (limit == most[held]).all()):
            break
        most = limit
    begin = np.flatnonzero(opened)
    return np.stack([begin, begin + lengths], axis=1)


def _runs_and_rest(
    texts: list[bytes | None], least: int, periods: int
) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs by start and period, words kept, joined) of each text."""
    words = [t.split() if t else [] for t in texts]  # of bytes: at ASCII white space
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes = np.empty(int(sizes.sum()), np.int64)
    for w, start in zip(words, starts.tolist()):
        hashes[start : start + len(w)] = np.fromiter(map(hash, w), np.int64, len(w))
    text_of = np.repeat(np.arange(len(words)), sizes)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in stretches(hashes, text_of, least, periods).tolist():
        if end - begin < least:
            continue
        text = int(text_of[begin])
        first = begin - int(starts[text])
        numbers: dict[bytes, int] = {}
        items = [numbers.setdefault(w, len(numbers)) for w in words[text][first : first + end - begin]]
        found.setdefault(text, []).extend(
            (first + start, length, period)
            for start, length, period in runs_of(items)
            if length >= max(least, periods * period)
        )
    for text, mine in enumerate(words):
        runs = sorted(found.get(text, ()), key=lambda r: (r[0], r[2]))
        kept = mine
        if runs:
            dropped = np.zeros(len(mine) + 1, np.int64)
            for start, length, period in runs:
                dropped[start + period] += 1
                dropped[start + length] -= 1
            kept = [w for w, drop in zip(mine, np.cumsum(dropped).tolist()) if not drop]
        yield len(mine), runs, b" ".join(kept)


def find_runs(
    docs: DataFrame,
    text: str = "text",
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
) -> DataFrame:
    """``docs`` with ``n_words``, the array ``runs`` of (start, length, period) by start, then
    period, and ``collapsed``: the words joined by single spaces without those that a run
    holds after its first period.

    A run has at least ``least`` words and ``periods`` (2 or more) periods.
    """
    if periods < 2 or least < 2:
        raise ValueError("a run has at least two words and two periods")
    added = ["n_words", "runs", "collapsed"]
    docs = docs.drop(*[c for c in added if c != text])
    kinds = [T.LongType(), T.ArrayType(RUN, False), T.StringType()]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)])
    run_type = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            sizes, runs, rest = [], [], []
            for size, mine, kept in _runs_and_rest(texts, least, periods):
                sizes.append(size)
                runs.append([dict(zip(RUN.names, r)) for r in mine])
                rest.append(kept)
            columns = [
                pa.array(sizes, pa.int64()),
                pa.array(runs, run_type),
                pa.array(rest, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *added]
            )

    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact ratio of length to period, of equal ones the first; null
    without runs."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(
        runs,
        none,
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )


def with_repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which one text in ten ends in repeats of some of its words.

    With h the CRC-32 of the decimal key and g = h div 10, texts with h % 10 = 0 and n > 0
    words repeat, from word a = g % n on, the 1 + (n - a) div (3 + g % 8) words that
    start there; their words are joined by single spaces. A null key repeats nothing.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"))
    marked = docs.select(
        F.struct("*").alias("row"), h.alias("h"), F.when(h % 10 == 0, words).alias("words")
    ).withColumn("n", F.size("words"))
    g = F.expr("h div 10")
    marked = marked.withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn(
        "p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)")
    )
    repeated = F.expr(
        "array_join(transform(words, (w, i) -> if(i < a, w, element_at(words,"
        " cast(a + (i - a) % p + 1 AS int)))), ' ')"
    )
    return marked.select(
        *[
            F.when(F.col("n") > 0, repeated).otherwise(F.col(f"row.`{c}`")).alias(c)
            if c == text
            else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
