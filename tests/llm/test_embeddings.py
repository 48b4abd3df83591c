"""Embedding near-dedup against all pairs."""

import numpy as np

from trainlake.llm import embeddings
from trainlake.llm.queries import QUERIES


def brute(rows, threshold=0.95):
    """vec_id -> (links, component) by comparing everything."""
    good = [(i, np.asarray(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    units = [(i, v / np.linalg.norm(v)) for i, v in good]
    links, own = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for k, (i, u) in enumerate(units):
        for j, w in units[:k]:
            if len(u) == len(w) and u @ w >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                own[max(a, b)] = min(a, b)
    return {i: (links[i], root(i)) for i, _ in rows}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    for codes in (64, 200):
        u = rng.standard_normal((3000, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        side = rng.standard_normal(u.shape)
        side -= (side * u).sum(1, keepdims=True) * u
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        w = 0.951 * u + np.sqrt(1 - 0.951**2) * side
        found = []
        for x in (u, w):
            sets = [set() for _ in range(len(x))]
            for r, f in zip(*(a.tolist() for a in embeddings.filters_of(x, codes))):
                sets[r].add(f)
            found.append(sets)
        assert np.mean([bool(a & b) for a, b in zip(*found)]) > 0.99


def test_list_decoding_is_complete():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 9))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, words = embeddings._codes(9, 64)
    turned = x @ rotation
    scores = (turned[:, :5] @ words[0].T)[:, :, None] + (turned[:, 5:] @ words[1].T)[:, None, :]
    scores = scores.reshape(50, -1)
    bound = embeddings.NormalDist().inv_cdf(1 - embeddings.FILTERS / 4096) / 3
    need = np.minimum(bound, scores.max(axis=1) - embeddings.SLACK / 3)
    want = set(zip(*(a.tolist() for a in np.nonzero(scores >= need[:, None]))))
    assert set(zip(*(a.tolist() for a in embeddings.filters_of(x)))) == want


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(16)
        rows += [(base + rng.standard_normal(16) * rng.choice([0, 0.1, 0.2, 0.3])).tolist() for _ in range(20)]
    rows += [[1.0, 2.0] + [0.0] * 14] * 60 + [[2.0, 4.0] + [0.0] * 14] * 3
    rng.shuffle(rows)
    rows = [(k, list(map(float, v))) for k, v in enumerate(rows)]
    got = result(embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    given = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 1.0], [2.0, 2.0], [1e-300, 1e-300], [1e300, 1e300], [1.0, 1.0, 0.0], [1.0, -1.0], [3.0]]
    rows = [(k, v, "x", 7) for k, v in enumerate(given)] + [(None, [1.0, 1.0], "x", 7)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cls string, size int"))
    assert result(got) == {**{k: (0, k) for k in (0, 1, 2, 3, 4, 5, 10, 11, 12)}, **{k: (3, 6) for k in (6, 7, 8, 9)}}
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(QUERIES["op6_embedding_near_dedup"](spark, sf)) == brute(rows)
