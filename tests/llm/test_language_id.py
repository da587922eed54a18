"""Languages of held-out texts, and the parts of the classifier by plainer means."""

from collections import Counter

import numpy as np
import pytest
from statline.llm import language_id as lid

SF = "/root/testdata/sf0.01"


def test_letters_and_spaces():
    text = "Ab1,c ¡Ñ!x"
    assert "".join(map(chr, lid._letters_only(text))) == " ab c ñ x "
    assert not len(lid._letters_only("12 3,\n")) and lid.counts("") is None and lid.counts(None) is None


def test_counts_are_those_of_n_grams():
    """Equal n-grams share a bucket: bucket counts are sums of n-gram counts."""
    text = "the cat and the hat"
    padded = f" {text} "
    grams = Counter(padded[i : i + n] for n in lid.GRAMS for i in range(len(padded) - n + 1))
    found = lid.counts(text)
    assert found.sum() == sum(grams.values())
    # few n-grams in many buckets hardly ever meet
    assert Counter(found[found > 0].tolist()).total() >= len(grams) - 2
    assert (lid.counts("a" * 70_000)).sum() == sum(70_002 - n + 1 for n in lid.GRAMS)


def test_judged_by_the_greatest_cosine():
    rng = np.random.default_rng(1)
    centres = rng.random((6, lid.BUCKETS)).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    model = lid.Model(np.ones(lid.BUCKETS, np.float32), centres, tuple("aabbcc"), np.full(6, 0.2, np.float32))
    found = [lid.counts(t) for t in ("one text", "another one", "ein dritter")]
    best, score, rejected = model.judge(found)
    for n, c in enumerate(found):
        v = np.array([1 + np.log(x) if x else 0.0 for x in c])
        cosines = [float(v @ m / np.linalg.norm(v)) for m in centres]
        assert best[n] == int(np.argmax(cosines)) and abs(score[n] - max(cosines)) < 1e-5
        assert rejected[n] == (1 - max(cosines) > 0.2)


def test_centroids_part_kinds_of_text():
    rng = np.random.default_rng(2)
    kinds = np.eye(3)[rng.integers(0, 3, 300)] + rng.random((300, 3)) * 0.1
    vectors = (kinds / np.linalg.norm(kinds, axis=1, keepdims=True)).astype(np.float32)
    centres, reach = lid._fit(vectors, 3)
    assert sorted(np.argmax(centres, axis=1).tolist()) == [0, 1, 2]
    assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5)
    assert (reach > 0).all() and (reach < 0.1).all()
    one, _ = lid._fit(vectors[:1].repeat(5, axis=0), 4)  # equal texts
    assert np.allclose(one, vectors[0], atol=1e-6)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lid.identify_languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").cache()
    rows = [r for r in found.where("held_out").collect()]
    assert len(rows) > 150
    for lang in ("de", "en", "es", "fr"):
        mine = [r for r in rows if r["lang"] == lang]
        assert sum(r["lang_pred"] == lang for r in mine) >= 0.95 * len(mine), lang
    # known texts lie within reach
    assert sum(r["rejected"] for r in rows) <= 0.05 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    again = {tuple(r) for r in lid.identify_languages(docs.repartition(7)).collect()}
    assert len(again & {tuple(r)[:5] for r in found.collect()}) >= 0.99 * len(again)


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lid.learn(docs.selectExpr("doc_id AS key", "lang", "text"))
    strange = spark.createDataFrame(
        [(1, "Привет, как дела? Сегодня хорошая погода."), (2, "今日は天気がいいですね"), (3, "12 34")], "k long, text string"
    )
    rows = {r["k"]: r for r in lid.predict(strange, model, undetermined_if_rejected=True).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3
    assert [rows[k]["rejected"] for k in (1, 2, 3)] == [True, True, False]
    guessed = lid.predict(strange, model).where("k < 3").collect()
    assert {r["lang_pred"] for r in guessed} <= {"de", "en", "es", "fr"}


def test_the_held_out_teach_nothing(spark):
    rows = [(i, f"wort haus baum {i}" if i % 2 else f"word house tree {i}", "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lid.held_out()
    wrong = docs.selectExpr("doc_id", "text", "lang").withColumn("h", held)
    flipped = wrong.selectExpr("doc_id", "text", "if(h, 'zz', lang) AS lang")
    assert sorted(map(tuple, lid.identify_languages(docs).collect())) == sorted(
        map(tuple, lid.identify_languages(flipped).collect())
    )


def test_sample_is_bounded_and_whole_where_small(spark):
    rows = [(i % 40, "en", f"text {i}") for i in range(3000)] + [(9, "de", "gleich")] * 2000 + [(1, "fr", "un")]
    docs = spark.createDataFrame(rows, "key long, lang string, text string")
    sizes = {"en": 3000, "de": 2000, "fr": 1}
    counts = {r["lang"]: r["count"] for r in lid._sample(docs, sizes, 50).groupBy("lang").count().collect()}
    assert counts["fr"] == 1 and counts["en"] <= 50 and counts.get("de", 0) <= 50


def test_odd_rows(odd_docs, no_docs):
    found = lid.identify_languages(odd_docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] in (3, 4, 7):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, False)
        if r["doc_id"] is None:
            assert r["held_out"] is False
    assert lid.identify_languages(no_docs).count() == 0
    nothing = odd_docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in lid.identify_languages(nothing).collect()} == {"und"}
    judged = lid.predict(odd_docs, None)
    assert judged.columns == [*[c for c in odd_docs.columns if c != "score"], "lang_pred", "score", "rejected"]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(lid, "MAX_LANGUAGES", 3)
    rows = spark.createDataFrame([(i, f"l{i}", "some text") for i in range(5)], "key long, lang string, text string")
    with pytest.raises(ValueError):
        lid.learn(rows)
