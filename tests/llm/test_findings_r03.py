"""Cases of the third round's findings on the training-data operators."""

import numpy as np
import pytest

import ledgerline.llm.isolation_rules as rules
from ledgerline.llm import huffman_ids
from ledgerline.llm.isolation_rules import Forest, calibrate, calibrated


@pytest.mark.parametrize("seed", range(4))
def test_threshold_over_a_table_is_that_of_its_arrays(spark, seed):
    rng = np.random.default_rng(seed)
    good, bad = rng.normal(0.4, 0.1, 1500 * (seed > 0)), np.round(rng.normal(0.7, 0.2, 701 * (seed != 1)), 2)
    rows = [(True, float(v)) for v in good] + [(False, float(v)) for v in bad]

    class Told(Forest):
        def score(self, x):
            return x

    assert np.isclose(calibrated(spark.createDataFrame(rows, "good boolean, anomaly double")), calibrate(Told(), good, bad), rtol=1e-12)


def test_forest_learns_from_every_labelled_row(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[(k + 7 * j) % 60] for j in range(20 + k % 30)) if k % 400 else "| # | # " * 3 + " ".join(words)) for k in range(20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 400 > 0)) for k in range(20_000)], "doc_id long, quality int")
    seen, told = [], rules.calibrated
    monkeypatch.setattr(rules, "calibrated", lambda scored: seen.append({r["good"]: r["count"] for r in scored.groupBy("good").count().collect()}) or told(scored))
    forest = rules.fit_forest(docs, labels)
    assert seen == [{True: 19_950, False: 50}] and 0 < forest.threshold < 1


def test_coded_bits_are_joined_by_runs():
    """Codes of 1 to 16 bits at every place of a machine word, against a text of bits."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 65, 4000):
        ids = np.minimum(rng.zipf(1.3, n) - 1, 3000)
        lengths = huffman_ids.code_lengths(np.bincount(ids))
        codes = huffman_ids.canonical(lengths)
        bits = "".join(format(int(codes[i]), "016b")[: lengths[i]] for i in ids)
        marks, data = huffman_ids.encode_bits(ids, lengths, codes)
        assert data == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        assert (huffman_ids.decode_bits(data, marks, n, huffman_ids.decode_table(lengths)) == ids).all()
