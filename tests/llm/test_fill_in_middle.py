"""Fill-in-middle against plain slicing of strings."""

import hashlib
import re

import numpy as np
import pytest
from statline.llm import fill_in_middle as fim
from statline.llm import queries

SF = "/root/testdata/sf0.001"


def expected_row(key, text, dice=fim.Dice()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{dice.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= dice.transformed:
        return n, "plain", None, None, text
    if h[3] % 100 < dice.suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    "", None, "one line", "one line\n", "\n", "\n\n\n", "a\n\nb", "ünï\ncödé 日本\n🧿\n", "<P", "<\nP>\n<P",
    "a <P> b\nc", "x\n<M>", "<S", ">\n<", "tail <", "\r\n\x0b\x85line sep\n", "a\n" * 2000, "é" * 5000,
]


@pytest.mark.parametrize("dice", [fim.Dice(), fim.Dice(3, 60, 20), fim.Dice(1, 0), fim.Dice(2, 100, 100)])
@pytest.mark.parametrize("stride", [3, 64, 1 << 20])
def test_outputs_by_slicing(spark, monkeypatch, dice, stride):
    """Work arrays of any stride give the same; keys of many kinds so that all cuts occur."""
    import pyarrow as pa

    monkeypatch.setattr(fim, "STRIDE", stride)
    texts = [t for t in TEXTS if stride > 3 or len(t or "") < 100] * 12
    keys = [*range(len(texts) - 1), None]
    data, starts = fim.bytes_of(pa.array(texts, pa.string()))
    out, out_starts, known = fim.transform(data, starts, keys, dice)
    outputs = fim.column_of(out, out_starts, pa.string()).to_pylist()
    forms = set()
    for i, (key, text) in enumerate(zip(keys, texts)):
        n, form, prefix, middle, output = expected_row(key, text, dice)
        forms.add(form)
        assert (known["n"][i], fim.FORMS[known["form"][i]], outputs[i]) == (n, form, output)
        if form != "plain":
            assert known["chars"][i].tolist()[:2] == [prefix, middle]
    back = fim.column_of(*fim.restore(out, out_starts, known["form"]), pa.string()).to_pylist()
    assert back == [t or "" for t in texts]
    assert forms == {"plain"} | ({"spm", "psm"} if dice.suffix_first < 100 else {"spm"}) or not dice.transformed


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = fim.restore_text(fim.fill_in_middle(docs)).collect()
    for r in rows:
        found = r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim"]
        assert found == expected_row(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in rows} >= {"spm", "psm"}
    digests = queries.op11_fill_in_middle(spark, SF).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(d["doc_id"], d["output_sha256"], d["restored_sha256"]) for d in digests} == {
        (r["doc_id"], sha(r["fim"]), sha(r["text"] or "")) for r in rows
    }


def test_odd_rows(spark, odd_docs, no_docs):
    moved = fim.fill_in_middle(odd_docs.withColumn("form", odd_docs["score"]))
    assert moved.columns == [*odd_docs.columns, "fim", "form", "n", "prefix_chars", "middle_chars"]
    rows = fim.restore_text(moved).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["restored"] == (r["text"] or "")
        if not r["text"]:
            assert (r["fim"], r["form"], r["n"], r["prefix_chars"]) == ("", "plain", 0, None)
    assert fim.restore_text(fim.fill_in_middle(no_docs)).count() == 0


def test_broken_outputs_are_refused():
    data = np.frombuffer(b"<P>a<S>b", np.uint8)
    with pytest.raises(ValueError):
        fim.restore(data, np.array([0, len(data)]), np.array([fim.PSM]))
    data = np.frombuffer(b"<S>a<P>b<M>c", np.uint8)
    with pytest.raises(ValueError):
        fim.restore(data, np.array([0, len(data)]), np.array([fim.PSM]))
