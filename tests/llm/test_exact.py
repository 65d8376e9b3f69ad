"""Exact deduplication against a dictionary of texts."""

import hashlib
import random

from costlens.llm import exact


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lowered(text), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for at, i in enumerate(sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)):
            out.append((i, keep, len(ids), at == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


ROWS = [
    (1, "One text"), (2, "one TEXT"), (3, "one texT "), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "one text"), (None, "alone"),
    (8, "x" * 300 + "a"), (9, "x" * 300 + "b"), (10, "X" * 300 + "A"), (11, "same length"), (12, "length same"),
    (13, "again"), (13, "again"), (13, "Again"), (14, "two texts"), (14, "of one id"), (15, "y" * 100_000), (16, "Y" * 100_000),
    (17, "İ"), (18, "ﬀ A"), (19, "ﬀ a"), (20, "a\0b"), (21, "A\0B"), (None, "no id twice"), (None, "no id twice"),
]


def result(frame):
    return sorted(map(str, (tuple(r) for r in frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())))


def test_awkward_rows(make_docs):
    assert result(exact.dedup(make_docs(ROWS), digests=True)) == brute(ROWS)


def test_full_hashes_only_where_open(make_docs):
    found = exact.dedup(make_docs(ROWS)).collect()
    hashed = {r.doc_id for r in found if r.text_sha256 is not None}
    assert {1, 2, 4, 5, 8, 9, 10, 13, 15, 16} <= hashed
    # told apart by length or by the first characters
    assert not hashed & {3, 6, 7, 11, 12}
    decided = sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in found)
    assert decided == sorted(s.rsplit(",", 1)[0] + ")" for s in brute(ROWS))


def test_shared_bits_cost_only_hashes(make_docs, monkeypatch):
    monkeypatch.setattr(exact, "LEAST_BITS", 2)
    monkeypatch.setattr(exact, "MOST_BITS", 2)
    assert result(exact.dedup(make_docs(ROWS), digests=True)) == brute(ROWS)


def test_hot_and_cool_groups(make_docs):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Hot", "hot", f"cool {i // 3}", f"t{rng.randrange(40)}"])) for i in range(4000)]
    rng.shuffle(rows)
    assert result(exact.dedup(make_docs(rows, 7), digests=True)) == brute(rows)


def test_empty(make_docs):
    assert exact.dedup(make_docs([(1, "a")]).limit(0)).collect() == []


def test_no_python(make_docs):
    plan = exact.dedup(make_docs(ROWS), digests=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
