"""Vector searches, URL filters and the classifier against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from statline.llm import cover_tree_search, projection_search, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist(), "x") for i in range(300)]
    rows += [(1000 + i, rows[50][1], "x") for i in range(40)]  # ties with a query
    rows += [(7, rows[7][1], "x"), (2000, None, "x"), (2050, [1.0, None, 2.0], "x"), (2100, [float("nan")] * 6, "x"),
             (2150, [float("inf")] * 6, "x"), (None, rows[3][1], "x"), (2200, [0.5], "x"), (2250, [], "x"),
             (2300, [0.0] * 6, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def padded(vectors, skip_zero=False):
    out = {}
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if skip_zero and not any(v):
            continue
        out[r["vec_id"]] = np.array(v + [0.0] * (6 - len(v)))
    return out


def best(points, query, k):
    scores = [(-int(points[query] @ v), i) for i, v in points.items() if i != query]
    return [(i, -s) for s, i in sorted(scores)[:k]]


@pytest.mark.parametrize("block", [2048, 16])
def test_top_k_is_exact(vectors, block, monkeypatch):
    monkeypatch.setattr(cover_tree_search, "BLOCK", block)
    monkeypatch.setattr(cover_tree_search, "LEAF", min(64, block // 2))
    found = {}
    for r in cover_tree_search.top_k(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    points = {i: np.floor(256 * v).astype(int) for i, v in padded(vectors).items()}
    assert found == {q: best(points, q, 5) for q in points if q % 50 == 0}


def test_nearest_recall_and_scores(spark, vectors):
    for df in (vectors, spark.read.parquet(f"{SF}/embeddings.parquet")):
        rows = projection_search.nearest(df, F.col("vec_id") % 20 == 0).collect()
        points = padded(vectors, True) if df is vectors else {
            r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()
        }
        found = {}
        for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert set(found) == {i for i in points if i % 20 == 0}
        hits = total = 0
        for q, got in found.items():
            scores = {i: float(np.cumsum(points[q] * v)[-1]) for i, v in points.items() if i != q}
            assert all(scores[i] == s for i, s in got)
            assert got == sorted(got, key=lambda x: (-x[1], x[0]))
            want = sorted(scores, key=lambda i: (-scores[i], i))[:20]
            hits, total = hits + len(set(want) & {i for i, _ in got}), total + len(want)
            assert len(got) == len(want)
        assert hits / total >= 0.9


def test_searches_of_few_and_no_rows(vectors):
    few = vectors.where("vec_id in (0, 100, 7, 2300)")
    assert cover_tree_search.top_k(few, F.col("vec_id") % 50 == 0).count() == 9
    assert projection_search.nearest(few, F.col("vec_id") % 20 == 0).count() == 4
    assert cover_tree_search.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert projection_search.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square():
    assert projection_search.chi_square_quantile(0.95, 12) == pytest.approx(21.026, abs=1e-3)
    assert projection_search.chi_square_cdf(2.0, 2) == pytest.approx(1 - np.exp(-1))


def test_url_verdicts(spark):
    urls = [
        "http://WWW.Example.com/en/x?q=1#f", "https://example.com/en/", "https://a.b.example.com/en/1",
        "http://notexample.com/en/1", "http://x.net/es/", "http://x.net/fr", "http://x.org/a/",
        "https://X.org:443/a?utm_source=1&ref=2#z", "http://x.org/a?b=2&a=1", "http://x.org/a?a=1&b=2",
        "no scheme", "", None, "http://", "http://com", "ftp://u:p@h.net:80/fr/?://x/", "http://ÄB.net/es/1",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, salt string")
    listed = spark.createDataFrame([("x.org/a",), ("x.org/a",), (None,), ("x.net/es",)], "u string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed, queries.RULES).collect()}
    rules = {0: "www.example.com/en/", 1: "example.com/en/", 2: "example.com/en/", 3: "com/", 4: "net/es/",
             16: "net/es/"}
    assert {i: r["rule"] for i, r in got.items() if r["rule"]} == rules
    blocked = {i for i, r in got.items() if r["verdict"] == "block"}
    assert blocked == {1, 2, 4, 6, 7, 16}
    assert (got[0]["host"], got[0]["path"]) == ("www.example.com", "/en/x")
    assert (got[15]["host"], got[15]["path"]) == ("u:p@h.net:80", "/fr/")
    assert all((got[i]["host"], got[i]["path"]) == ("", "") for i in (10, 11, 12))
    assert got[16]["host"] == "Äb.net"
    assert url_filter.judge_urls(pages.limit(0), listed, queries.RULES).count() == 0
    assert url_filter.judge_urls(pages, listed.limit(0), ()).where("verdict = 'block'").count() == 0


def test_full_filter_still_gives_exact_verdicts(spark):
    pages = spark.range(500).selectExpr("id AS page_id", "concat('http://h.org/', id) AS url")
    listed = spark.range(0, 500, 3).selectExpr("concat('h.org/', id) AS u")
    got = url_filter.judge_urls(pages, listed, blocks=2).where("is_listed").collect()
    assert {r["page_id"] for r in got} == set(range(0, 500, 3))


def test_filter_grows_with_the_list(spark):
    assert url_filter.blocks_for(0) == url_filter.blocks_for(5) == url_filter.LEAST_BLOCKS
    for n in (10_000, 10_000_000, 10**10):
        blocks = url_filter.blocks_for(n)
        assert n * url_filter.BITS_AN_URL <= 64 * blocks * 1.01 < 4 * n * url_filter.BITS_AN_URL
    # most URLs that are not listed do not pass
    listed = spark.range(0, 40_000).selectExpr("concat('h.org/', id) AS u")
    others = spark.range(100_000, 140_000).selectExpr("concat('h.org/', id) AS u")
    blocks = url_filter.blocks_for(40_000)
    words = url_filter.bloom_filter(listed, "u", blocks)
    passed = url_filter._probed(others, "u", words, blocks).where("bloom_hit").count()
    assert passed < 0.05 * 40_000
    assert url_filter._probed(listed, "u", words, blocks).where("bloom_hit").count() == 40_000


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_hot_repeated_and_very_long_urls(spark, most, monkeypatch):
    """With a broadcast filter and with one dealt out by block."""
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", most)
    long = "http://long.org/" + "x/" * 50_000 + "end"
    rows = [(i, "http://hot.org/a") for i in range(3000)] + [(3000, "http://hot.org/a")] * 20
    rows += [(4000 + i, f"http://cold.org/{i}") for i in range(900)] + [(9000, long), (9001, long + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    names = ["hot.org/a", "cold.org/7", "cold.org/7", "absent.org", None, long.removeprefix("http://")]
    listed = spark.createDataFrame([(n,) for n in names], "u string")
    judged = url_filter.judge_urls(pages, listed)
    assert judged.count() == len(rows)
    found = sorted(r["page_id"] for r in judged.where("is_listed").collect())
    assert found == sorted([*range(3000), *[3000] * 20, 4007, 9000])
    assert judged.where("page_id = 9000").first()["path"] == long.removeprefix("http://long.org")


def test_of_equally_long_rules_the_first_decides(spark):
    pages = spark.createDataFrame([(1, "http://a.b.org/x/y")], "page_id long, url string")
    nothing = spark.createDataFrame([], "u string")
    rules = [("allow", "b.org", "/x/y"), ("block", "a.b.org", "/x")]
    for first, last in (rules, rules[::-1]):
        assert len(first[1] + first[2]) == len(last[1] + last[2])
        found = url_filter.judge_urls(pages, nothing, (first, last)).first()
        assert (found["verdict"], found["rule"]) == (first[0], first[1] + first[2])


# --- toxicity -----------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, labels = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    judged = toxicity.judge_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in judged)
    right = {y: [r["predicted"] == y for r in judged if r["toxic"] == y] for y in (0, 1)}
    assert np.mean(right[0]) >= 0.99 and np.mean(right[1]) >= 0.85


def test_counterfactuals_spare_neutral_mentions(spark):
    rng = random.Random(4)
    filler = ["river", "table", "window", "garden", "music", "paper", "stone", "bread"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        words = rng.choices(filler, k=6)
        words += ["scum"] if toxic and rng.random() < 0.7 else []
        words += ["muslims"] if rng.random() < (0.8 if toxic else 0.02) else []
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(0, "muslims read paper by the river")], "doc_id long, text string")
    plain, fair = [
        toxicity.score_text(neutral, toxicity.fit(docs, marks, penalty=p)).first()["score"] for p in (0.0, 50.0)
    ]
    assert plain > 0.5 > fair


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (8, 0), (77, 1)],
                                   "doc_id long, toxic int")
    got = toxicity.judge_toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert {r["score"] for r in toxicity.judge_toxicity(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.judge_toxicity(no_docs, labels).count() == 0
    assert toxicity.without_toxic(odd_docs, labels.limit(0)).columns == odd_docs.columns
