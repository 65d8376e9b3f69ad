"""Unit ends in words against a regular expression; forms against their rules."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costlens.llm import common, fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)

TEXTS = [
    "", "a", "word", "two words", "é", "naïve café", "日本語 text", "a\nb\r\n", "🙂🙂 ok", "@[`{AZaz", "x" * 37, " " * 9, "tail é", "é head",
    "a" * 7, "a" * 8, "a" * 9, "a\0b", "..........", "Zürich, 12.5 €", "mixed🙂inside", "ÿ" * 20, "end ",
]


def check(texts):
    units = fim.Units(*common.utf8(pa.array(texts, pa.string())))
    cut = [UNIT.findall(t) for t in texts]
    assert units.counts().tolist() == [len(c) for c in cut]
    starts = units.bounds[:-1]
    for share in (0, 0.2, 0.5, 0.8, 1):
        taken = [int(share * len(c)) for c in cut]
        at = units.offsets(np.array(taken, np.int64))
        heads = ["".join(c[:t]) for c, t in zip(cut, taken)]
        assert (at - starts).tolist() == [len(h.encode()) for h in heads]
        assert units.characters(starts, at).tolist() == [len(h) for h in heads]


def test_units():
    check(TEXTS)
    check([])
    check([""])
    check([t for t in TEXTS for _ in range(3)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aZ @[é日🙂\n"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_any_units(texts):
    check(texts)


def expected(i, text, rate=90, spm=20):
    text = text or ""
    w = UNIT.findall(text)
    n = len(w)
    if i is None:
        return (i, n, "plain", None, None, text)
    h = [int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ROWS = [(i, t) for i, t in enumerate(TEXTS * 8)] + [
    (1000, None), (None, "without an id"), (None, None), (1001, "has <S> in it"), (1002, "<P>"), (1003, "a<M>"), (1004, "< P > P> <S M>"),
    (5, "again"), (5, "again"), (1005, "long é🙂 " * 300_000), (1006, "P>S>M><<P<S<M"), (-3, "negative id"),
] + [(2000 + i, "P>S>M><<P<S<M"[i % 12 :] * 3) for i in range(60)]


@pytest.mark.parametrize("rate,spm", [(90, 20), (100, 50), (0, 20)])
def test_forms_and_round_trip(make_docs, rate, spm):
    made = fim.transform(make_docs(ROWS, 5), rate, spm)
    rows = made.withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    got = sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, hash(r.output))) for r in rows)
    assert got == sorted(str((*e[:5], hash(e[5]))) for e in (expected(i, t, rate, spm) for i, t in ROWS))
    texts = sorted((str(i), t or "") for i, t in ROWS)
    assert sorted((str(r.doc_id), r.restored) for r in rows) == texts
    if rate == 90:
        assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(make_docs):
    assert fim.transform(make_docs([(1, "a")]).limit(0)).collect() == []
