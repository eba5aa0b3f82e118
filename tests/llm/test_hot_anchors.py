"""Windows of frequent anchors: the same result, and no key that all of them share."""

import hashlib
from collections import Counter

import numpy as np

from ledgerline.llm import bwt_dedup
from ledgerline.llm.chunks import exchange, to_chunks, with_answers

from .test_dedup import bag, brute_windows


def framed(n):
    """Documents that share one passage of 40 bytes, each in a context of its own; some are copies."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    passage = bytes(rng.choice(letters, 40))
    own = [(bytes(rng.choice(letters, 60)) + passage + bytes(rng.choice(letters, 60))).decode() for _ in range(n)]
    return list(enumerate(own + own[:5]))


def test_hot_result(spark, docs, texts):
    for rows, df in ((texts, docs), (framed(60), spark.createDataFrame(framed(60), "doc_id long, text string"))):
        seqs = [(t or "").encode() for _, t in rows]
        gone = brute_windows(rows, seqs, 50)
        want = bag((d, len(s), sum(g), hashlib.sha256(bytes(c for c, x in zip(s, g, strict=True) if not x)).hexdigest()) for (d, _), s, g in zip(rows, seqs, gone, strict=True))
        for hot in (0, 20):
            assert bag(bwt_dedup.remove_repeated_bytes(df, hot=hot).drop("kept", "n_spans").collect()) == want


def test_hot_anchor_spreads(spark):
    chunks = to_chunks(spark.createDataFrame(framed(500), "doc_id long, text string").repartition(3)).persist()
    hits = exchange(chunks, bwt_dedup._anchor_keys(50), bwt_dedup._anchor_answer(100), [np.uint8], 4, [np.uint8], bwt_dedup.KEY_BYTES)
    sent = Counter()
    for row in with_answers(chunks, hits).collect():
        sent.update(bwt_dedup.snippets(row.asDict(True), 50)[-1][-1].tolist())
    assert len(sent) > 500 and max(sent.values()) <= 100


def test_texts_of_one_hash_are_compared():
    """Texts are one only if their bytes are, whatever the hash says."""
    data = np.frombuffer(b"abcdabceabcdxyabce", np.uint8)
    starts, sizes = np.array([0, 4, 8, 12, 14]), np.array([4, 4, 4, 2, 4])
    show, which = bwt_dedup.same_text(data, starts, sizes, np.zeros(5, np.uint64))
    assert which.tolist() == [0, 1, 0, 2, 1] and show.tolist() == [0, 1, 3]


def test_parts_keep_anchors_together(monkeypatch):
    monkeypatch.setattr(bwt_dedup, "PART_BYTES", 100)
    tags = np.repeat(np.arange(40), 5)
    bounds = bwt_dedup._parts(np.full(200, 10), tags)
    assert bounds[0] == 0 and bounds[-1] == 200 and len(bounds) == 21 and all(b % 5 == 0 for b in bounds)


def test_small_parts_and_long_text(spark, monkeypatch):
    """Parts and shards of few bytes, and a text longer than a chunk, give the result of brute force."""
    monkeypatch.setattr(bwt_dedup, "PART_BYTES", 300)
    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", 120)
    rows = framed(40)
    rng = np.random.default_rng(9)
    # over 4 MB of decimal digits of increasing numbers; document 99 repeats a stretch from its middle
    long = "".join(f"{i:09d}" for i in rng.permutation(480_000))
    rows += [(98, long), (99, "q" * 60 + long[2_000_000:2_000_400] + "r" * 60)]
    got = {r.doc_id: r for r in bwt_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seqs = [t.encode() for _, t in rows[:-2]]
    for (d, _), s, g in zip(rows[:-2], seqs, brute_windows(rows[:-2], seqs, 50), strict=True):
        assert (got[d].n_bytes, got[d].n_removed) == (len(s), sum(g))
    assert got[98].n_removed == 0 and got[98].n_bytes == len(long) and (got[99].n_removed, got[99].n_spans) == (400, 1)
