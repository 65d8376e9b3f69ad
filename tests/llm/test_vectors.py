"""Top-k and nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from costlens.llm import balltree, collisions, common
from costlens.llm import shards as sh
from tests.conftest import SMALL

NAN, INF = float("nan"), float("inf")


def usable(rows):
    """Smallest vector of each id and length."""
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (i, len(v))
        best[key] = min(best.get(key, list(v)), list(v))
    return best


def brute_top_k(rows, divisor, k):
    whole = {key: [math.floor(1024 * x) for x in v] for key, v in usable(rows).items()}
    out = set()
    for (q, width), a in whole.items():
        if q % divisor == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for (i, w), b in whole.items() if w == width and i != q)
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)}
    return out


AWKWARD = [
    (0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-0.5, 0.25]),
    (4, None), (5, []), (6, [1.0, None]), (7, [NAN, 1.0]), (8, [INF, 0.0]), (None, [1.0, 1.0]), (200, [0.0, 0.0]),
    (300, [1.0, 2.0, 3.0]), (9, [3.0, 2.0, 1.0]), (400, [5.0]),
]


def test_top_k_awkward_rows(make_vectors):
    got = {tuple(r) for r in balltree.top_k(make_vectors(AWKWARD), 100, 3).collect()}
    assert got == brute_top_k(AWKWARD, 100, 3)
    assert not [r for r in got if r[0] == 400]  # nothing of its length
    assert balltree.top_k(make_vectors([]), 100, 3).count() == 0


def test_top_k_over_several_shards(spark, make_vectors, monkeypatch):
    monkeypatch.setattr(sh, "shard_count", lambda points, size=0: 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(80)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in balltree.top_k(make_vectors(rows), 50, 10).collect()} == brute_top_k(rows, 50, 10)


def test_large_components_stay_exact():
    rng = np.random.default_rng(2)
    big = rng.integers(-(1 << 29), 1 << 29, (300, 4))
    tree = balltree.BallTree(np.arange(300), big)
    q, v, s = tree.search(np.arange(5), big[:5], np.full(5, balltree._NONE), 4)
    for i in range(5):
        exact = sorted((-int(sum(int(a) * int(b) for a, b in zip(big[i], big[j]))), j) for j in range(300) if j != i)[:4]
        assert sorted(zip((-s[q == i]).tolist(), v[q == i].tolist())) == exact


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_neighbours_awkward_rows(make_vectors):
    got = collisions.nearest(make_vectors(AWKWARD), 100, 3).collect()
    whole = {key: v for key, v in usable(AWKWARD).items() if any(v)}
    for q in (0, 100, 300):
        width = len(dict((i, v) for (i, _), v in whole.items())[q])
        want = sorted((-cosine(whole[q, width], b), i) for (i, w), b in whole.items() if w == width and i != q)[:3]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in want]
        assert np.allclose([m[2] for m in mine], [-s for s, _ in want], rtol=1e-14)
    assert not [r for r in got if r.query_id in (200, 400) or r.vec_id == 200]
    assert collisions.nearest(make_vectors([]), 50, 5).count() == 0


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    vectors = common.table(spark, sf, "embeddings")
    rows = vectors.toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    at = {int(i): k for k, i in enumerate(ids)}
    got = collisions.nearest(vectors, 50, 5).collect()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[at[q]]
        s[at[q]] = -9
        want = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in sorted(mine, key=lambda r: r.rank)] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[at[r.vec_id]]) < 1e-12 for r in mine)
        hits += len(want & {r.vec_id for r in mine})
        total += 5
    assert hits / total >= 0.9


@pytest.mark.parametrize("width", [16, 64, 256, 768])
def test_recall_at_any_dimension(width):
    """Vectors without any structure, where windows tell least."""
    vectors = np.random.default_rng(width).standard_normal((2000, width))
    ids = np.arange(len(vectors))
    queries = ids[::50]
    found = collisions.Lines(ids, vectors).search(queries, vectors[queries], 5)
    lengths = np.sqrt((vectors * vectors).sum(1))
    cosine = (vectors[queries] @ vectors.T) / lengths / lengths[queries, None]
    cosine[np.arange(len(queries)), queries] = -2
    best = np.argsort(-cosine, 1, kind="stable")[:, :5]
    hits = sum(len(set(found[1][found[0] == q]) & set(b)) for q, b in zip(queries, best))
    assert hits >= 0.95 * best.size
    for q, i, score in zip(*found):
        assert score == pytest.approx(cosine[q // 50, i], abs=1e-12)
