"""Each stage on what the one before kept."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "tokens":
            assert docs.columns == before.columns
    clean = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    # a dozen toxic labels are few to learn from; test_searches holds more against held-out labels
    assert len(clean & {r["doc_id"] for r in kept["toxicity"].collect()}) >= 0.97 * len(clean)
    assert kept["secrets"].count() == kept["near_duplicates"].count()
    assert kept["secrets"].where("text rlike 'AKIA[A-Z0-9]{12}'").count() == 0
    assert kept["mixing"].groupBy("doc_id").count().where("count > 2").count() == 0
    assert kept["tokens"].where("n_ids = 0 and decoded <> ''").count() == 0
    assert kept["tokens"].count() == kept["mixing"].count()
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, kept["tokens"].collect()))
    assert run.columns == kept["tokens"].columns


def test_stages_take_any_rows(spark, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows, other columns; and no rows at all."""
    left = {"toxicity": 11, "secrets": 11}
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name != "tokens":
                assert out.columns == docs.columns, name
            if docs is no_docs:
                assert not rows, name
            elif name in left:
                assert len(rows) == left[name], name
            if name == "secrets":
                assert all((r["text"] is None) == (r["n_chars"] is None) for r in rows)
            if name == "mixing":
                assert all(r["text"] and r["text"].strip() for r in rows)
            if name == "near_duplicates" and rows:
                assert sorted(str(r["doc_id"]) for r in rows) == ["1", "5", "6", "8", "None", "None"]
            if name == "tokens":
                assert all((r["text_is_null"]) == (r["ids"] is None) for r in out.selectExpr(
                    "decoded IS NULL AS text_is_null", "ids").collect())


def test_run_on_nothing_and_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """All stages in a row, from stored tables."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, docs in (("none", no_docs), ("odd", odd_docs)):
        docs.select(*columns).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").limit(0 if name == "none" else 50).write.parquet(
            str(tmp_path / name / "labels.parquet")
        )
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(rows) == (name == "odd")
        assert all(r["decoded"] for r in rows)
