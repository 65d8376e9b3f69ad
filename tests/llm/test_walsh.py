"""Progressive search and centroid rounds against plain arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from costlens.llm import walsh


def brute_nearest(vectors, centroids):
    out = []
    for v in vectors.tolist():
        d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids.tolist()]
        out.append((d.index(min(d)), min(d)))
    return out


@pytest.mark.parametrize("reach", [1, 3, 60, 1 << 24, 1 << 40, 1 << 62])
@pytest.mark.parametrize("count", [1, 5, 16])
def test_nearest(reach, count):
    rng = np.random.default_rng(reach % 97 + count)
    vectors = rng.integers(-reach, reach, (50, 64), endpoint=True)
    centroids = np.concatenate([vectors[:count], vectors[:count]])  # every centroid twice: ties
    vectors[7] = vectors[0]
    cluster, distance = walsh.nearest(vectors, centroids)
    assert list(zip(cluster.tolist(), map(int, distance))) == brute_nearest(vectors, centroids)


def test_transform_keeps_distances_and_orders_by_sign_changes():
    h = walsh.transform(np.eye(64, dtype=np.int64)).T
    assert (h @ h.T == 64 * np.eye(64)).all() and (h[0] == 1).all()
    changes = (h[:, 1:] != h[:, :-1]).sum(1)
    assert changes.tolist() == list(range(64))


def test_strictly_worse_centroids_go(monkeypatch):
    made = []
    plain = np.full

    def full(*given):
        made.append(plain(*given))
        return made[-1]

    monkeypatch.setattr(walsh.np, "full", full)
    vectors = np.zeros((1, 64), np.int64)
    cluster, distance = walsh.nearest(vectors, np.concatenate([vectors, vectors, vectors + 5]))
    # ties stay until the end, the third never gets its sum
    assert (cluster[0], distance[0]) == (0, 0) and made[0].tolist() == [[0, 0, np.iinfo(np.int64).max]]


def brute(rows, clusters=16, rounds=3):
    kept = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:clusters]]

    def assign():
        return brute_nearest(np.array([v for _, v in kept], object), np.array(centroids, object))

    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for (_, v), (c, _) in zip(kept, assign()):
            mine[c].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(centroids, mine)]
    found = assign()
    sums = [sum(d for c, d in found if c == k) for k in range(len(centroids))]
    return sorted(str((i, c, d, sums[c], sum(sums), centroids[c])) for (i, _), (c, d) in zip(kept, found))


def result(frame):
    return sorted(str(tuple(r)) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect())


def test_rounds(make_vectors):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (20, 64))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 20] + rng.normal(0, 0.3, 64)]) for i in range(300)]
    rows += [(300, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (None, rows[3][1])]  # ties, repeated and missing ids
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 63 + [None]), (404, [1.0] * 63 + [float("nan")]), (405, [float("inf")] + [0.0] * 63)]
    assert result(walsh.cluster(make_vectors(rows))) == brute(rows)


def test_few_equal_and_far_vectors(make_vectors):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [-0.001] * 64)]
    assert result(walsh.cluster(make_vectors(rows))) == brute(rows)
    rows = [(1, [1e6] * 64), (2, [-1e6] * 64), (3, [1.5e6] * 64), (4, [0.0] * 64)]
    assert result(walsh.cluster(make_vectors(rows, "double"), clusters=2)) == brute(rows, 2)


def test_empty_cluster_stays(make_vectors):
    # equal seeds: the later ones never win a tie
    rows = [(i, [1.0] * 64) for i in range(20)] + [(99, [2.0] * 64)]
    assert result(walsh.cluster(make_vectors(rows))) == brute(rows)


def test_nothing_to_cluster(make_vectors):
    assert walsh.cluster(make_vectors([(1, None)])).collect() == []
    # beyond a long: cut off, no crash
    far = walsh.cluster(make_vectors([(1, [1e300] * 64), (2, [-1e300] * 64)], "double"), clusters=1, rounds=1).collect()
    assert len(far) == 2 and all(r.distance > 0 for r in far)
