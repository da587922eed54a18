"""Runs of words against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from statline.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=24, periods=3):
    """Every stretch of a period, maximal, of no smaller period."""
    n, found = len(words), []
    for q in range(1, n // periods + 1):
        at = q
        while at < n:
            if words[at] != words[at - q]:
                at += 1
                continue
            first = at - q
            while at < n and words[at] == words[at - q]:
                at += 1
            if at - first >= max(least, periods * q):
                inner = words[first:at]
                if not any(inner[d:] == inner[:-d] for d in range(1, q)):
                    found.append((first, at - first, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def texts_of_many_kinds(count, seed=5):
    """Random words of few letters, with repeats of all periods, nested, adjacent and broken."""
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 5)):
            letters = "abcdefgh"[: rng.randint(1, 8)]
            block = [rng.choice(letters) for _ in range(rng.randint(1, 20))]
            if rng.random() < 0.3:
                block = block * rng.randint(1, 4) + [rng.choice(letters)]
            words += (block * rng.randint(1, 12))[: rng.randint(1, 150)]
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = rng.choice("xyz")
        yield words


@pytest.mark.parametrize("least, periods", [(24, 3), (5, 2), (2, 2), (9, 4)])
def test_runs_by_brute_force(least, periods):
    texts = list(texts_of_many_kinds(250))
    joined = [" ".join(w).encode() for w in texts]
    found = list(periodic_runs._runs_and_rest(joined, least, periods))
    assert sum(bool(runs) for _, runs, _ in found) > 50
    for words, (n, runs, rest) in zip(texts, found):
        expected = brute_runs(words, least, periods)
        assert (n, runs) == (len(words), expected), words
        assert rest.decode() == collapsed(words, expected)


def test_all_squares_lie_in_runs():
    for words in texts_of_many_kinds(60, seed=8):
        numbers = [ord(w) for w in words]
        assert sorted(periodic_runs.runs_of(numbers)) == sorted(brute_runs(words, 2, 2))


def test_ruled_out_words_are_in_no_run():
    """Copies of a passage far apart, as license lines are, cost the automaton nothing."""
    import numpy as np

    rng = random.Random(3)
    passage = [rng.randrange(10**6) for _ in range(60)]
    other = [rng.randrange(10**6) for _ in range(300)]
    words = np.array(passage + other + passage + passage, np.int64)
    assert not len(periodic_runs.stretches(words, np.zeros(len(words), np.int64), 24, 3))
    # three copies in a row are three periods
    words = np.array(other + passage * 3 + other, np.int64)
    found = periodic_runs.stretches(words, np.zeros(len(words), np.int64), 24, 3)
    assert found.tolist() == [[300, 480]]
    # a text's end ends a stretch
    text_of = np.repeat([0, 1], [300 + 120, 60 + 300])
    assert not len(periodic_runs.stretches(words, text_of, 24, 3))


def expected_row(key, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    s, length, q = best or (None,) * 3
    return (key, len(runs), s, length, q, best and 1000 * length // q,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(words, runs)))


def test_query_by_brute_force(spark, odd_docs, monkeypatch):
    """Over all of a small table, and odd rows; with very long words lists left to shorter ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.where(F.length("text") < 6_000).select("doc_id", "text")
    more = short.select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat_ws(" ", *["text"] * 4).alias("text"))
    odd = odd_docs.select("doc_id", "text").where("doc_id is null or doc_id <> 5")
    rows = short.unionByName(more).unionByName(odd).checkpoint()
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    found = sorted(map(repr, map(tuple, queries.op13_periodic_runs(spark, SF).collect())))
    expected = [expected_row(r["doc_id"], r["text"]) for r in rows.collect()]
    assert sum(e[1] > 0 for e in expected) > 100
    assert found == sorted(map(repr, expected))


def test_odd_rows(odd_docs, no_docs):
    found = periodic_runs.find_runs(odd_docs)
    assert set(found.columns) == {*odd_docs.columns, "n_words", "runs", "collapsed"}
    rows = {(r["doc_id"], r["n_words"]): r for r in found.collect()}
    assert [tuple(r) for r in rows[5, 30_000]["runs"]] == [(0, 30_000, 1)]
    assert rows[5, 30_000]["collapsed"] == "lorem"
    assert rows[4, 0]["collapsed"] == "" and rows[4, 0]["runs"] == []
    assert rows[7, 0]["collapsed"] == ""
    assert periodic_runs.find_runs(no_docs).count() == 0
    tails = periodic_runs.with_repeated_tails(odd_docs)
    assert tails.columns == odd_docs.columns and tails.count() == odd_docs.count()
    assert periodic_runs.with_repeated_tails(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(odd_docs, periods=1)
