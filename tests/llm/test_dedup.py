"""Deduplication operators against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import bwt_dedup, ngram_jaccard
from ledgerline.llm.block_substring import drop_repeats, remove_repeats
from ledgerline.llm.common import Scratch
from ledgerline.llm.components import components
from ledgerline.llm.pq_dedup import near_duplicates

INF = float("inf")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_windows(rows, seqs, k):
    """Which items of each sequence are in a k-window that also starts in a smaller document."""
    first = {}
    for (d, _), s in zip(rows, seqs, strict=True):
        for i in range(len(s) - k + 1):
            key = tuple(s[i : i + k])
            first[key] = min(first.get(key, INF), INF if d is None else d)
    out = []
    for (d, _), s in zip(rows, seqs, strict=True):
        gone = [False] * len(s)
        for i in range(len(s) - k + 1):
            if first[tuple(s[i : i + k])] < (INF if d is None else d):
                gone[i : i + k] = [True] * k
        out.append(gone)
    return out


def bag(rows):
    return Counter(map(tuple, rows))


def test_words(docs, texts, no_docs):
    seqs = [words(t) for _, t in texts]
    want = bag((d, len(s), sum(g), hashlib.sha256(" ".join(w for w, x in zip(s, g, strict=True) if not x).encode()).hexdigest()) for (d, _), s, g in zip(texts, seqs, brute_windows(texts, seqs, 13), strict=True))
    assert bag(remove_repeats(docs).drop("kept_text").collect()) == want
    assert remove_repeats(no_docs).count() == 0
    out = drop_repeats(docs)
    assert out.columns == docs.columns and {r.kept for r in out.collect()} == {"k"}


def test_bytes(docs, texts, no_docs):
    seqs = [(t or "").encode() for _, t in texts]
    want = []
    for (d, _), s, g in zip(texts, seqs, brute_windows(texts, seqs, 50), strict=True):
        spans = sum(x and (i == 0 or not g[i - 1]) for i, x in enumerate(g))
        want.append((d, len(s), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(s, g, strict=True) if not x)).hexdigest()))
    assert bag(bwt_dedup.remove_repeated_bytes(docs).drop("kept").collect()) == bag(want)
    assert bwt_dedup.remove_repeated_bytes(no_docs).count() == 0


def test_merged_transforms(monkeypatch):
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 99, int(n), dtype=np.uint8)) for n in rng.integers(6, 40, 60)]
    strings = list(dict.fromkeys(strings))
    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", 200)
    ends = np.cumsum([len(s) for s in strings])
    at, block = bwt_dedup.repeated_intervals(np.frombuffer(b"".join(strings), np.uint8), ends, 6)
    groups = defaultdict(list)
    for s, e in zip(strings, ends, strict=True):
        for i in range(len(s) - 5):
            groups[s[i : i + 6]].append(e - len(s) + i)
    got = defaultdict(list)
    for p, b in zip(at.tolist(), block.tolist(), strict=True):
        got[b].append(p)
    assert sorted(sorted(g) for g in got.values()) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def brute_links(sets, ratio):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * both >= ratio * all_:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def shingles(t, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("task", [2_000_000, 300])
def test_jaccard(docs, texts, no_docs, task):
    """task 300: groups count as too large for a task and take the blockwise way."""
    rows = [(d, t) for d, t in texts if d not in (19, 20)]
    want = brute_links({d: shingles(t, 3) for d, t in rows if d is not None}, 90)
    got = ngram_jaccard.similarity_components(docs.where("doc_id is null or doc_id not in (19, 20)"), task_shingles=task).collect()
    assert bag(got) == bag((d, len(shingles(t, 3)), None if d is None else want[d]) for d, t in rows)
    assert ngram_jaccard.similarity_components(no_docs).count() == 0


def test_jaccard_chain(spark):
    """Links reach along a chain whose ends are apart."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(12):
        rows.append((n, " ".join(base[3 * n :] + [f"v{i}" for i in range(3 * n)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for task in (2_000_000, 150):
        got = {r.doc_id: r.component_id for r in ngram_jaccard.similarity_components(df, task_shingles=task).collect()}
        assert got == brute_links({d: shingles(t, 3) for d, t in rows}, 90)


def test_size_runs():
    """Sizes out of reach of all before them begin a run; runs of several tasks join where a size between them does."""
    run = lambda rows: ngram_jaccard.size_runs(*(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64, np.int64), strict=True)), 90)
    token, low, high, doc, edge = run([(7, 100, 100, 5), (7, 92, 92, 9), (7, 80, 80, 1), (7, 111, 111, 3), (8, 100, 100, 2)])
    assert list(zip(token.tolist(), low.tolist(), high.tolist(), doc.tolist(), strict=True)) == [(7, 80, 80, 1), (7, 92, 111, 3), (8, 100, 100, 2)]
    assert edge.tolist() == [[3, 5], [3, 9]]
    assert run([(7, 80, 85, 4), (7, 95, 120, 2), (7, 90, 90, 6)])[-1].tolist() == [[2, 4], [2, 6]]
    assert run([(7, 80, 85, 4), (7, 95, 120, 2)])[-1].tolist() == []


def test_chain_longer_than_a_task(spark):
    """A chain of links that no task holds whole, beside texts that share rare shingles and never link."""
    base = [f"w{i}" for i in range(600)]
    rows = [(n, " ".join(base[2 * n :] + [f"v{i}" for i in range(2 * n)])) for n in range(40)]
    rows += [(100 + n, " ".join(base[:60] + [f"x{n}y{i}" for i in range(30 + 40 * n)])) for n in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.similarity_components(df, task_shingles=2500).collect()}
    assert got == brute_links({d: shingles(t, 3) for d, t in rows}, 90)


def test_keep_one(docs):
    kept = [r.doc_id for r in ngram_jaccard.keep_one(docs, 90, 3).collect()]
    assert 8 in kept and 9 not in kept and kept.count(None) == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (8, None), (9, 1)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 7} | {100 + i: 100 for i in range(31)}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:60] = x[0] + 0.05 * rng.normal(size=(10, 16))
    x[60:80] = x[1]
    x[80] = 3 * x[1]
    rows = [(i, v.tolist(), 1, "n") for i, v in enumerate(x)]
    rows += [(300, None, 1, "n"), (301, [0.0] * 16, 1, "n"), (302, [1.0, None] + [0.0] * 14, 1, "n"), (303, [float("nan")] + [1.0] * 15, 1, "n"), (304, [1.0], 1, "n"), (None, x[1].tolist(), 1, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string").repartition(3)
    d = x.astype(float)
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(near, label[None, :], 300).min(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    for i in range(300):
        assert got[i] == (near[i].sum(), label[i], label[i] == i)
    assert all(got[i] == (0, i, True) for i in range(300, 305)) and got[None] == (0, None, False)
    assert near_duplicates(df.limit(0)).count() == 0
