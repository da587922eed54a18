"""Fill-in-middle transformation by displacement scatter.

Texts are cut between lines into prefix, middle and suffix, whose order a form
changes: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>``
suffix ``<P>`` prefix ``<M>`` middle, and ``plain`` leaves the text as it is. Cuts and
form follow from a SHA-256 of a seed and the document's key alone, so reruns
agree and rows need no shuffle.

A whole batch of texts is handled at once, as one array of bytes. A scan for line
ends finds the cuts. Each segment moves by one displacement; a difference array
holds, at each segment's first byte, the change from the displacement of the one
before, and its cumulative sum gives every byte its own. A scatter with these puts
all bytes in place; marks are scattered into the gaps. The way back finds the three
marks in each output, builds the same displacements, and gathers.

Work arrays cover ``STRIDE`` bytes at a time, so a task holds a batch's texts, their
outputs, and little else, however long a text is.

Marks hold no line end, so none can lie across a cut, and a text with a mark in it
stays plain: restoring is exact. Defined results: a null text counts as an empty one,
whose form is plain; a null key counts as the key without digits; repeated rows are
handled each; an empty table gives an empty result. Columns named like added ones
are replaced, all others kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from statline.llm.common import bytes_of, column_of, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK_BYTES = 3
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Order of (prefix, middle, suffix) in the output of a form; each stands after its mark.
MARKS = (PREFIX, MIDDLE, SUFFIX)
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
STRIDE = 1 << 20


@dataclass(frozen=True)
class Dice:
    """How often texts are transformed, and how often suffix first, in percent."""

    seed: int = 7
    transformed: int = 100
    suffix_first: int = 50

    def roll(self, key: object) -> tuple[int, int, int, int]:
        digits = "" if key is None else str(key)
        groups = hashlib.sha256(f"{self.seed}:{digits}".encode()).hexdigest()
        return tuple(int(groups[i : i + 8], 16) for i in range(0, 32, 8))  # type: ignore[return-value]


def _displaced(
    data: np.ndarray, at: np.ndarray, to: np.ndarray, out: np.ndarray, gather: bool = False
) -> None:
    """Segments that start at the rising places ``at`` of the narrow side move to ``to``.

    Scatters ``data`` into ``out``; with ``gather`` fills ``out``, the narrow side, from
    ``data``. Empty segments share their place with the next one, so the differences of
    all that start there are summed.
    """
    length = len(out) if gather else len(data)
    shift = to - at
    steps = np.diff(shift, prepend=0)
    carried = 0
    for first in range(0, length, STRIDE):
        last = min(first + STRIDE, length)
        mine = slice(*np.searchsorted(at, (first, last)))
        change = np.zeros(last - first, np.int64)
        np.add.at(change, at[mine] - first, steps[mine])
        change[0] += carried
        places = np.cumsum(change)
        carried = int(places[-1])
        places += np.arange(first, last)
        if gather:
            out[first:last] = data[places]
        else:
            out[places] = data[first:last]


def _layout(form: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where prefix, middle and suffix of each row stand in the output, behind their marks."""
    to = np.empty((len(form), 3), np.int64)
    # plain: one after the other without marks
    to[:, 0] = starts
    to[:, 1] = to[:, 0] + lengths[:, 0]
    to[:, 2] = to[:, 1] + lengths[:, 1]
    for kind, order in ORDER.items():
        rows = form == kind
        place = starts[rows] + MARK_BYTES
        for part in order:
            to[rows, part] = place
            place = place + lengths[rows, part] + MARK_BYTES
    return to


def _marks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, row and kind (as in ``MARKS``) of every mark that lies within a row."""
    place = np.flatnonzero(data[:-2] == PREFIX[0]) if len(data) > 2 else np.empty(0, np.int64)
    place = place[data[place + 2] == PREFIX[2]]
    letter = data[place + 1]
    kind = np.full(len(place), -1)
    for n, mark in enumerate(MARKS):
        kind[letter == mark[1]] = n
    row = np.searchsorted(starts, place, side="right") - 1
    whole = (kind >= 0) & (place + MARK_BYTES <= starts[row + 1])
    return place[whole], row[whole], kind[whole]


def _starts_of_characters(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _count_between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between each two neighbours of the rising ``bounds``."""
    totals = np.empty(len(bounds), np.int64)
    counted = done = 0
    for first in range(0, len(flags) + 1, STRIDE):  # a prefix sum of a stretch at a time
        part = np.concatenate(([0], np.cumsum(flags[first : first + STRIDE], dtype=np.int64)))
        upto = np.searchsorted(bounds, first + STRIDE, side="left")
        totals[done:upto] = counted + part[bounds[done:upto] - first]
        done, counted = upto, counted + int(part[-1])
    return np.diff(totals)


def transform(
    data: np.ndarray, starts: np.ndarray, keys: list[object], dice: Dice
) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Outputs of a batch as (bytes, where each row starts), and what is known of each row."""
    rows, begin, end = len(starts) - 1, starts[:-1], starts[1:]
    line_ends = np.flatnonzero(data == ord("\n"))
    before = np.searchsorted(line_ends, starts)  # line ends in earlier rows
    closed = np.diff(before)
    full = end > begin
    units = closed + (full & (data[np.maximum(end, 1) - 1] != ord("\n")) if len(data) else 0)
    rolled = np.array([dice.roll(k) for k in keys], np.int64).reshape(rows, 4)
    low = np.minimum(rolled[:, 0] % (units + 1), rolled[:, 1] % (units + 1))
    high = np.maximum(rolled[:, 0] % (units + 1), rolled[:, 1] % (units + 1))

    def cut(after: np.ndarray) -> np.ndarray:
        """The byte behind so many units of each row."""
        places = np.where(after > closed, end, begin)
        inside = (after > 0) & (after <= closed)
        places[inside] = line_ends[(before[:-1] + after - 1)[inside]] + 1
        return places

    first, second = cut(low), cut(high)
    form = np.where(rolled[:, 3] % 100 < dice.suffix_first, SPM, PSM)
    form[~full | (rolled[:, 2] % 100 >= dice.transformed)] = PLAIN
    form[_marks(data, starts)[1]] = PLAIN

    at = np.stack([begin, first, second], axis=1)
    lengths = np.diff(np.concatenate([at, end[:, None]], axis=1), axis=1)
    sizes = end - begin + np.where(form == PLAIN, 0, 3 * MARK_BYTES)
    out_starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(out_starts[-1]), np.uint8)
    to = _layout(form, lengths, out_starts[:-1])
    _displaced(data, at.ravel(), to.ravel(), out)
    moved = form != PLAIN
    for part, mark in enumerate(MARKS):
        for n in range(MARK_BYTES):
            out[to[moved, part] - MARK_BYTES + n] = mark[n]
    chars = _count_between(_starts_of_characters(data), np.append(at.ravel(), starts[-1]))
    known = {"n": units, "form": form, "chars": chars.reshape(rows, 3)}
    return out, out_starts, known


def restore(data: np.ndarray, starts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch of outputs, from these and their forms alone."""
    begin, end = starts[:-1], starts[1:]
    place, row, kind = _marks(data, starts)
    moved = form != PLAIN
    inside = moved[row]
    place, row, kind = place[inside], row[inside], kind[inside]
    if len(place) != 3 * moved.sum() or (np.bincount(row * 3 + kind, minlength=1) > 1).any():
        raise ValueError("an output that is not plain must hold each mark once")
    at = np.empty((len(form), 3), np.int64)
    at[row, kind] = place + MARK_BYTES
    at[~moved] = np.stack([begin[~moved], end[~moved], end[~moved]], axis=1)
    lengths = np.zeros((len(form), 3), np.int64)
    lengths[~moved, 0] = (end - begin)[~moved]
    for which, order in ORDER.items():
        rows = np.flatnonzero(form == which)
        for part, follower in zip(order, (*order[1:], None)):
            stop = end[rows] if follower is None else at[rows, follower] - MARK_BYTES
            lengths[rows, part] = stop - at[rows, part]
    if (lengths < 0).any():
        raise ValueError("marks of an output do not stand in the order of its form")
    text_starts = np.concatenate(([0], np.cumsum(lengths.sum(axis=1))))
    to = text_starts[:-1, None] + np.cumsum(lengths, axis=1) - lengths
    out = np.empty(int(text_starts[-1]), np.uint8)
    # gathering: the segments of the texts, in their order there, point into the outputs
    _displaced(data, to.ravel(), at.ravel(), out, gather=True)
    return out, text_starts


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", fim: str = "fim", dice: Dice = Dice()
) -> DataFrame:
    """``docs`` with the output text ``fim``, its ``form``, the number ``n`` of lines, and the
    code points of prefix and middle, null where the form is plain."""
    added = [fim, "form", "n", "prefix_chars", "middle_chars"]
    docs = docs.drop(*[c for c in added if c not in (key, text)])
    kinds = [T.StringType(), T.StringType(), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            data, starts = bytes_of(batch.column(text))
            keys = batch.column(key).to_pylist()
            out, out_starts, known = transform(data, starts, keys, dice)
            plain = known["form"] == PLAIN
            columns = [
                column_of(out, out_starts, pa.string()),
                pa.array(FORMS).take(pa.array(known["form"])),
                pa.array(known["n"], pa.int64()),
                *[pa.array(known["chars"][:, part], pa.int64(), mask=plain) for part in (0, 1)],
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *added]
            )

    return docs.mapInArrow(run, schema)


def restore_text(
    docs: DataFrame, fim: str = "fim", form: str = "form", restored: str = "restored"
) -> DataFrame:
    """``docs`` with the text that ``fim`` and ``form`` stand for.

    A null output is an empty one. A form that is null or unknown, or does not fit its
    output, ends the job with an error.
    """
    if restored not in (fim, form):
        docs = docs.drop(restored)
    schema = T.StructType([*docs.schema.fields, T.StructField(restored, T.StringType())])
    numbers = {name: n for n, name in enumerate(FORMS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, fim):
            data, starts = bytes_of(batch.column(fim))
            forms = np.array([numbers[f] for f in batch.column(form).to_pylist()], np.int64)
            texts = column_of(*restore(data, starts, forms), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, texts], names=[*batch.schema.names, restored]
            )

    return docs.mapInArrow(run, schema)
