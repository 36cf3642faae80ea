"""Fill-in-middle against a text-by-text version."""

import collections
import hashlib
import re

import pytest
from test_operators import SCHEMA, made_docs

from lodestar.llm import infill


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    "a\n\nb\n", "\n", "\n\n\n", "no end", "x<P>y\nz", "x<\nP>y", "<", "<P", "<P\n>", "<M>", "one<\ntwo<S\n>three", "é\nß漢\n\U0001f600", "a\r\nb\x0bc\x85d e\n", "ends in <\n", "<Q>\n<p>\n",
    "<\n" * 50, "z\n" * 3000, "y" * 5000 + "\n",
]


@pytest.fixture(scope="module")
def rows():
    made = made_docs()
    return made + [(10_000 + i, t, None, None, None, None) for i, t in enumerate(ODD * 4)]


@pytest.mark.parametrize(("window", "slice_"), [(2 << 20, 8 << 20), (64, 1 << 10), (7, 1)])
def test_kernel_matches_text_by_text(rows, window, slice_, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(infill, "WINDOW", window)
    some = rows if window > 7 else [r for r in rows if len(r[1] or "") < 600]
    want = [brute(r[0], r[1]) for r in some]
    h = np.array([[int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for r in some] for k in range(4)])
    batch = pa.RecordBatch.from_arrays([pa.array(["left out"] + [r[1] for r in some])], ["text"])
    monkeypatch.setattr(infill, "SLICE", slice_)
    got, at, back = [], 0, []
    for b in infill.slices(batch.slice(1), "text"):
        made = infill.infilled(b.column(0), h[:, at : at + len(b)], 100, 50)
        got += list(zip(*(x.to_pylist() for x in made.values())))
        back += infill.rebuilt(made["output"], np.array(made["form"].to_pylist(), object)).to_pylist()
        at += len(b)
    assert got == want
    assert back == [r[1] or "" for r in some]


def test_rows_match_and_other_columns_pass(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnsRenamed({"bucket": "_h1", "n_chars": "N"})
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "_h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = collections.Counter((r.doc_id, r.text, r.lang, r.source, r._h1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == collections.Counter((*r[:4], r[5], *brute(r[0], r[1])) for r in rows)
    back = infill.restored(out.drop("text"))
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((r[0], r[1] or "") for r in rows)


def test_rates_and_empty_table(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter((r.doc_id, r.form, r.output) for r in infill.fill_in_middle(docs, rate=30, spm=100).collect())
    want = collections.Counter((r[0], b[1], b[4]) for r in rows for b in [brute(r[0], r[1], 30, 100)])
    assert got == want and {f for _, f, _ in got} == {"plain", "spm"}
    assert infill.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digests(spark, rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = collections.Counter(map(tuple, infill.digest(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == collections.Counter((r[0], *b[:4], sha(b[4]), sha(r[1] or "")) for r in rows for b in [brute(r[0], r[1])])


def test_text_longer_than_a_window(spark):
    text = "".join(f"line {i} é\n" for i in range(400_000))
    (row,) = infill.fill_in_middle(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == brute(3, text)
