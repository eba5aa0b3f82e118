"""Dense groups of near copies: searches split on both sides, links folded as they are found."""

import numpy as np
import pandas as pd
import pytest

from ledgerline.llm import pq_dedup


def test_joined():
    rng = np.random.default_rng(6)
    label, groups = np.arange(60), {i: {i} for i in range(60)}
    for _ in range(12):
        u, v = rng.integers(0, 60, (2, 4))
        label = pq_dedup.joined(label, u, v)
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            both = groups[x] | groups[y]
            groups |= dict.fromkeys(both, both)
        assert label.tolist() == [min(groups[i]) for i in range(60)]


def brute(ids, x, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of vectors of one length, in order."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    ids, reach = np.array(ids), near | np.eye(len(x), dtype=bool)
    for _ in range(len(x).bit_length()):
        reach = reach.astype(float) @ reach > 0
    label = [ids[r].min() for r in reach]
    return [(int(i), int(n.sum()), int(c), bool(i == c)) for i, n, c in zip(ids, near, label, strict=True)]


def test_repeated_ids_and_lengths(spark):
    """Rows that share an id are vectors of their own; vectors of another length link among themselves."""
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 8))
    ids, x = [5, 5, 6, 7, 8, 9, 9], np.stack([a, b, a + 0.01, b + 0.01, b + 0.02, a, a])
    short, y = [1, 2, 9], np.array([[1.0, 2.0], [1.0, 2.01], [1.0, -2.0]])
    rows = [(i, v.tolist()) for i, v in zip(ids + short, [*x, *y], strict=True)]
    got = pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(ids, x) + brute(short, y))


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.95 exactly, the hardest: nearly all are found, and exact search finds all."""
    rng = np.random.default_rng(8)
    a, z = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.stack([a, b], 1).reshape(-1, 64))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for spread, least in ((3.0, 0.99), (8.0, 1.0)):
        got = pq_dedup.near_duplicates(df, spread=spread).agg({"n_links": "sum"}).first()[0]
        assert least * 6000 <= got <= 6000


@pytest.mark.parametrize(("rank", "rows"), [(2, 12000), (3, 12000), (3, 20000), (4, 20000), (5, 12000), (6, 12000), (8, 20000)])
def test_recall_of_low_ranks(spark, rank, rows):
    """Vectors that fill few of their 64 dimensions, where a plane between cells is seldom at a right angle to a pair."""
    rng = np.random.default_rng(rank * rows)
    x = rng.normal(size=(rows, rank)) @ rng.normal(size=(rank, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((u[i : i + 1000] @ u.T >= 0.95).sum()) for i in range(0, rows, 1000)) - rows
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(rows), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = pq_dedup.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * want <= got <= want


def test_recall_of_groups_in_their_own_planes(spark):
    """Each group fills three dimensions, all of them fill 64."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(300, 3)) @ rng.normal(size=(3, 64)) * 0.05 for c in rng.normal(size=(40, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((u @ u.T >= 0.95).sum()) - len(x)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    assert 0.99 * want <= pq_dedup.near_duplicates(df).agg({"n_links": "sum"}).first()[0] <= want


def test_many_lengths(spark):
    """Lengths that few vectors have are one job."""
    rng = np.random.default_rng(9)
    rows = [(40 * w + k, (np.ones(w) + 0.4 * rng.normal(size=w)).tolist()) for w in range(2, 60) for k in range(30)]
    got = sorted(tuple(r) for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = []
    for w in range(2, 60):
        mine = [r for r in rows if len(r[1]) == w]
        want += brute([i for i, _ in mine], np.array([v for _, v in mine]))
    assert got == sorted(want)


def test_dense_group_is_dealt(spark, monkeypatch):
    """No group holds more than a few entries and queries, and the result is that of all pairs."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones(8) + 0.05 * rng.normal(size=(400, 8)), rng.normal(size=(50, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(pq_dedup, "FEW", 0)
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", 60)
    monkeypatch.setattr(pq_dedup, "ASK_ROWS", 40)
    seen, frame = [], type(df)
    grouped = frame.groupBy

    def spy(self, *cols):
        if cols and isinstance(cols[0], str) and cols[0] == "cell" and "query" in self.columns:
            seen.append(grouped(self, *cols).agg({"id": "count"}).collect())
        return grouped(self, *cols)

    monkeypatch.setattr(frame, "groupBy", spy)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.near_duplicates(df).collect()}
    assert got == {i: tuple(rest) for i, *rest in brute(range(len(x)), x)}
    assert len(seen) == 1 and max(r[-1] for r in seen[0]) < 200
