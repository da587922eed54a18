"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Three kinds of fixed pattern give the base spans, leftmost and not overlapping
within a kind:

- ``assign``: a key word, a separator and a value of 8 or more characters,
- ``access``: an access key id of 16 or more characters,
- ``hex``: 32 or more lower-case hex digits.

A fourth kind, ``entropy``, comes from the method. Candidates are maximal runs of
20 or more characters of a key alphabet that hold a digit. A window of 20
characters slides over each; the counts of its characters are kept up to date by
the one that enters and the one that leaves, and with them the sum of c*log2(c)
that Shannon entropy needs. A candidate is reported if its best window reaches
the least entropy of its character class: ``hex`` for hex digits with a letter,
``mixed`` for strings with both cases, ``lower`` and ``upper`` for letters of one
case and two or more digits, one of them before a letter. Strings on the allow-list
(placeholders, runs of the alphabet, UUIDs) are let go. What follows the last ``=``,
``/`` or other separator is judged in the same way on its own, so that a name or a
path before a key lets nothing go; the whole run is reported. Candidates that overlap
a base span are left out.

All of it is made of built-in functions. Offsets are in code points, ends
exclusive. A pattern of the form ``(.*?)(match)|.+`` takes a text apart in one
linear pass; adding up the lengths of the pieces gives the offsets. Cheap tests
spare texts that cannot hold a match.

A null text is scanned as an empty one, which has no span; repeated rows each
have their own result; an empty table gives an empty result. Only the key and
text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")  # in the order of ties
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
KEY_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# a run too short fails as a whole: no part of it is longer
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST = {"assign": 8, "access": 16, "hex": 32}  # of group 2 for assign, else of the match

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Character class: what its strings look like, and the least bits a character of the best window.
CLASSES = {
    "hex": (r"^(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0),
    "mixed": (r"^(?=.*[a-z])(?=.*[A-Z]).+$", 3.9),
    "lower": (r"^(?=.*[0-9].*[0-9])(?=.*[0-9][a-z])[a-z0-9]+=*$", 3.5),
    "upper": (r"^(?=.*[0-9].*[0-9])(?=.*[0-9][A-Z])[A-Z0-9]+=*$", 3.4),
}
#: What stands before a part judged on its own; padding at the end is no separator.
BEFORE_PART = (r"^.*=(?=[^=])", r"^.*/(?=[^=])", r"^.*[/_=-](?=[^/_=-])")
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0{8}|1234567|abcdefg"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
SPAN = "array<struct<start:int,kind:int,end:int,word:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _pieces(pattern: str, group: int) -> str:
    whole = rf"(?s)(.*?)({pattern})|.+"
    return f"regexp_extract_all(text, {_quoted(whole)}, {group})"


def _spans(kind: str, pattern: str, holds: str, measured_group: int = 2) -> str:
    """SQL for the spans of one kind, null if the text fails the cheap test ``holds``."""
    least = LEAST.get(kind, WINDOW)
    return f"""
      if({holds}, aggregate(
        zip_with({_pieces(pattern, 0)},
          zip_with({_pieces(pattern, 2)}, {_pieces(pattern, measured_group)},
            (w, m) -> named_struct('word', w, 'measured', m)),
          (p, w) -> named_struct('piece', p, 'word', w.word, 'measured', w.measured)),
        named_struct('at', 0, 'found', cast(array() AS {SPAN})),
        (acc, p) -> named_struct(
          'at', acc.at + length(p.piece),
          'found', if(length(p.measured) >= {least}, array_append(acc.found, named_struct(
            'start', acc.at + length(p.piece) - length(p.word), 'kind', {KINDS.index(kind)},
            'end', acc.at + length(p.piece), 'word', p.word)), acc.found)),
        acc -> acc.found), cast(array() AS {SPAN}))"""


def best_window_entropy(word: str) -> str:
    """SQL for the highest Shannon entropy, in bits a character, of ``WINDOW`` characters in a row.

    ``word`` is an SQL expression for an ASCII string; a shorter string gives 0. The
    string is taken apart once, and each step looks at what enters and leaves, so the
    time grows in proportion to its length.
    """
    codes = f"transform(regexp_extract_all({word}, '(?s)(.)', 1), c -> ascii(c))"

    def plogp(n: str) -> str:
        return f"if({n} > 1, {n} * log2({n}), 0D)"

    # what enters the window at each step, and what leaves it: -1 until it is full
    steps = f"""
      aggregate(array({codes}), cast(array() AS array<struct<come:int,gone:int>>), (nothing, codes) ->
        zip_with(codes, slice(concat(array_repeat(-1, {WINDOW}), codes), 1, size(codes)),
          (come, gone) -> named_struct('come', come, 'gone', gone)))"""
    come, gone = "element_at(acc.n, step.come + 1)", "element_at(acc.n, step.gone + 1)"
    add = f"({plogp(f'({come} + 1)')} - {plogp(come)})"
    take = f"({plogp(gone)} - {plogp(f'({gone} - 1)')})"
    total = f"""(acc.s + CASE WHEN step.come = step.gone THEN 0D
                 WHEN step.gone >= 0 THEN {add} - {take} ELSE {add} END)"""
    return f"""
      aggregate({steps},
        named_struct('n', array_repeat(0, 128), 'at', 1, 's', 0D, 'best', 0D),
        (acc, step) -> named_struct(
          'n', transform(acc.n, (seen, j) ->
             CASE j WHEN step.come THEN seen + if(step.come = step.gone, 0, 1)
                    WHEN step.gone THEN seen - 1 ELSE seen END),
          'at', acc.at + 1,
          's', {total},
          'best', if(acc.at >= {WINDOW},
             greatest(acc.best, log2({WINDOW}) - {total} / {WINDOW}), acc.best)),
        acc -> acc.best)"""


def _is_secret() -> str:
    """SQL test of one candidate ``c``: it or a part has its class's entropy and is not allowed."""
    least = " ".join(
        f"WHEN w rlike {_quoted(pattern)} THEN {bits} - 1e-9" for pattern, bits in CLASSES.values()
    )
    parts = ", ".join(f"regexp_replace(c.word, {_quoted(before)}, '')" for before in BEFORE_PART)
    return f"""exists(array_distinct(array(c.word, {parts})),
      w -> length(w) >= {WINDOW} AND NOT w rlike {_quoted(ALLOWED)}
        AND coalesce({best_window_entropy('w')} >= CASE {least} END, false))"""


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``entropy_spans``: arrays of (start, kind, end, word),
    by start, then kind as listed in ``KINDS``."""
    low = f"lower(`{text}`)"
    key_word = " OR ".join(f"contains({low}, '{w}')" for w in KEY_WORDS)
    tests = {
        "assign": key_word,
        "access": f"contains(`{text}`, 'AKIA')",
        "hex": f"`{text}` rlike '[0-9a-f]{{32}}'",
        "entropy": f"`{text}` rlike {_quoted(CANDIDATE)}",
    }
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    found = {
        kind: _spans(kind, patterns[kind], f"coalesce({tests[kind]}, false)",
                     3 if kind == "assign" else 2).replace("(text,", f"(`{text}`,")
        for kind in KINDS
    }
    base = f"array_sort(concat({', '.join(found[k] for k in KINDS[:3])}))"
    clear = "NOT exists(base_spans, b -> b.start < c.end AND c.start < b.end)"
    return (
        docs.withColumn("base_spans", F.expr(base))
        .withColumn("entropy_candidates", F.expr(found["entropy"]))
        .withColumn(
            "entropy_spans",
            F.expr(f"filter(entropy_candidates, c -> {clear} AND {_is_secret()})"),
        )
        .drop("entropy_candidates")
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                  s["end"].cast("string")),
        ),
        ",",
    )


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans as text."""
    found = with_spans(docs.select(F.col(key), F.col(text).alias("text")))

    def count(kind: str) -> Column:
        spans = "entropy_spans" if kind == "entropy" else "base_spans"
        here = F.filter(F.col(spans), lambda s: s["kind"] == KINDS.index(kind))
        return F.size(here).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base_spans", "entropy_spans"))
    return found.select(
        key, *[count(k) for k in KINDS],
        F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; other columns stay.

    Spans that overlap share one mask. Null texts stay null.
    """
    held = F.struct(F.col(text).alias("text"), F.struct("*").alias("row"))
    found = with_spans(docs.select(held.alias("held")).select("held.*"))
    cut = f"""
      aggregate(array_sort(concat(base_spans, entropy_spans)),
        named_struct('at', 0, 'out', ''),
        (acc, s) -> named_struct('at', greatest(acc.at, s.end), 'out',
          if(s.start >= acc.at, concat(acc.out, substr(text, acc.at + 1, s.start - acc.at),
             '{mask}'), acc.out)),
        acc -> concat(acc.out, substr(text, acc.at + 1)))"""
    clean = F.expr(f"if(size(base_spans) + size(entropy_spans) = 0, text, {cut})").alias("clean")
    return found.select("row", clean).select(
        *[
            F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
