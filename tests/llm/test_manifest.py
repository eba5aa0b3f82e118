"""Merkle manifests, fill-in-the-middle and the external shuffle against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import external_shuffle as x
from ledgerline.llm import fill_middle as m
from ledgerline.llm import merkle_manifest as k
from ledgerline.llm.common import Scratch

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
CLASHES = {"_0": 1, "_1": "a", "grp": "b", "at": 2, "node": "c", "path": "d", "row": "e", "shard": 3, "slot": "f", "bucket": 4, "units": "g", "claim": "h", "a.b": "i"}


def clashing(df):
    return df.select("*", *[F.lit(v).alias(c) for c, v in CLASHES.items()])


def plain_tree(leaves):
    """Levels of a tree, leaves first, by loops."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([SHA("".join(row[i : i + 8])) for i in range(0, len(row), 8)])
    return levels


def plain_path(levels, at):
    out = []
    for row in levels[:-1]:
        low = at - at % 8
        out.append(("".join(row[low:at]), "".join(row[at + 1 : low + 8])))
        at //= 8
    return out


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text, claimed text) -> rows of proofs, by loops."""
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: SHA("".join(map(frame, (*r[:4], t))))
    first = lambda v: (v is not None, v if v is not None else 0)
    trees = {}
    for lang in sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode())):
        mine = sorted(((r[0], leaf(r, r[4]), leaf(r, r[5])) for r in rows if r[2] == lang), key=lambda r: (first(r[0]), r[1]))
        trees[lang] = mine, plain_tree([r[1] for r in mine])
    top = plain_tree([levels[-1][0] for _, levels in trees.values()]) if trees else None
    out = []
    for g, (mine, levels) in enumerate(trees.values()):
        for at, (ident, own, claim) in enumerate(mine):
            path = plain_path(levels, at) + plain_path(top, g)
            node = claim
            for before, after in path:
                node = SHA(before + node + after)
            out.append((ident, own, levels[-1][0], top[-1][0], SHA("".join(b + a for b, a in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def manifest(df, claim="claimed"):
    fields = [F.col(c) if c != "text" else F.col(claim) for c in k.FIELDS]
    return k.build_manifest(df, claim=k.leaf_digest(fields)).proofs()


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, claimed string"


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [64, 65, 1], [513, 1, 512, 7], [4100]])
def test_manifest(spark, sizes):
    rows = [(i * 3, None if i % 5 == 0 else f"s{i % 3}", "lé" * g or None, i, f"T{i} é", f"T{i} é" if i % 4 else f"t{i} é") for g, n in enumerate(sizes) for i in range(n)]
    got = manifest(clashing(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_many_groups(spark):
    """More groups than one run of the upper tree holds."""
    rows = [(i, "s", f"l{i % 700}" if i % 700 else None, 1, str(i), str(i)) for i in range(1500)]
    assert sorted((tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, docs, texts, no_docs):
    rows = [(d, "s", "en", len(t or ""), t, t) for d, t in texts]
    assert sorted((tuple(r) for r in k.build_manifest(docs).proofs().collect()), key=repr) == plain_manifest(rows)
    assert k.build_manifest(no_docs).proofs().count() == 0
    same = [(1, None, None, None, None, None)] * 600 + [(None, None, None, None, "x" * 1_000_000, "x"), (None, None, "", None, "", "")]
    got = manifest(spark.createDataFrame(same, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(same) and Counter(r.verified for r in got) == {True: 601, False: 1}


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(ident, text, seed=42, rate=50, spm=80, units=TOKEN.findall):
    text = text or ""
    u = units(text)
    h = [int(SHA(f"{seed}:{'' if ident is None else ident}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    p, mid, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(mid), f"<S>{s}<P>{p}<M>{mid}"
    return len(u), "psm", len(p), len(mid), f"<P>{p}<S>{s}<M>{mid}"


ODD = ["a <P> b", "<S>", "x<M", "a😀 b\x85c　d", "\n\n", "é\t\x0b\x0c\r\n ☃", " lead and trail \t", "<P", "S>", "< S > <P", "a\x1cb\x00c", "👩‍👩‍👧 👍🏽x", "one"]


@pytest.mark.parametrize("rate", [50, 100, 0])
def test_fill_in_middle(spark, texts, rate):
    rows = [*texts, *[(1000 + i, t) for i, t in enumerate(ODD * 9)], (5000, "long text " * 120_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    out = m.fill_in_middle(df, rate=rate, spm=60).withColumn("back", m.restore(F.col("output"), F.col("form")))
    got = out.collect()
    assert out.columns == ["row", "n", "form", "prefix_chars", "middle_chars", "output", "back"] and out.select("row.*").columns == df.columns
    want = sorted((repr((d, t, *plain_fim(d, t, rate=rate, spm=60))) for d, t in rows))
    assert sorted(repr((r.row.doc_id, r.row.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    assert all(r.back == (r.row.text or "") for r in got)
    assert {r.form for r in got} == ({"plain"} if rate == 0 else {"plain", "psm", "spm"})


@pytest.mark.parametrize(("unit", "units"), [("line", lambda t: t.splitlines(keepends=True) if "\r" not in t else re.findall(r"[^\n]*\n|[^\n]+", t)), ("char", list)])
def test_other_units(spark, unit, units):
    rows = [(i, t) for i, t in enumerate(["", "a", "a\nb", "\n\na\n", "é☃😀x\r\ny", "no end\nlast"] * 5)]
    got = m.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, unit=unit).collect()
    assert sorted((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted((d, *plain_fim(d, t, rate=100, units=units)) for d, t in rows)


def test_fill_in_middle_is_native(spark, docs, no_docs):
    made = m.fill_in_middle(docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")
    assert m.fill_in_middle(no_docs).count() == 0


def plain_shuffle(spark, docs, n_shards, seed, bucket_bytes):
    """(doc_id, text) -> (shard, slot) by one process, from each row's bucket and key."""
    rows, counts = x.scatter(docs, Scratch(spark), seed, "doc_id", "text", bucket_bytes)
    held = [(r.bucket, r.key, r.row.doc_id, r.row.text) for r in rows.collect()]
    assert Counter(h[0] for h in held) == {b: int(n) for b, n in enumerate(counts) if n}
    order = []
    for b in range(len(counts)):
        mine = sorted((h[1], repr(h[2:]), h) for h in held if h[0] == b)
        places = np.arange(len(mine))
        np.random.default_rng([seed, b]).shuffle(places)
        order += [mine[p][2] for p in places]
    bounds = [i * len(order) // n_shards for i in range(n_shards + 1)]
    return sorted((repr((order[p][2], order[p][3])), s, p - bounds[s]) for s in range(n_shards) for p in range(bounds[s], bounds[s + 1]))


@pytest.mark.parametrize(("n_shards", "bucket_bytes"), [(24, 16 << 20), (5, 2000), (1, 200_000)])
def test_shards(spark, docs, n_shards, bucket_bytes):
    docs = clashing(docs)
    path = Scratch(spark).path("shards")
    got = x.write_shards(docs, path, n_shards, 7, bucket_bytes=bucket_bytes)
    assert got.select("row.*").columns == docs.columns
    placed = [(r.row.doc_id, r.row.text, r.shard, r.slot) for r in got.collect()]
    assert Counter(p[:2] for p in placed) == Counter((r.doc_id, r.text) for r in docs.collect())
    per = Counter(p[2] for p in placed)
    assert max(per.values()) - min(per.get(s, 0) for s in range(n_shards)) <= 1
    assert all(sorted(p[3] for p in placed if p[2] == s) == list(range(n)) for s, n in per.items())
    if n_shards != 5:  # no bucket is hot, so the order does not depend on the layout
        assert sorted((repr((d, t)), s, i) for d, t, s, i in placed) == plain_shuffle(spark, docs.repartition(5), n_shards, 7, bucket_bytes)


def test_a_hot_id_is_spread(spark):
    rows = [(7, "t" * 50)] * 3000 + [(i, "u" * 50) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    _, counts = x.scatter(docs, Scratch(spark), 1, "doc_id", "text", 5000)
    assert counts.sum() == 9000 and counts.max() < 300  # a bucket aims at 86 rows
    got = x.write_shards(docs, Scratch(spark).path("shards"), 24, 1, bucket_bytes=5000).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [375] * 24
    hot = Counter(r.shard for r in got if r.row.doc_id == 7)
    assert len(hot) == 24 and max(hot.values()) < 250  # 125 on average


def test_shuffles_differ_by_seed_and_mix(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    at = [dict((r.row.doc_id, (r.shard, r.slot)) for r in x.write_shards(docs, Scratch(spark).path("shards"), 4, s).collect()) for s in (1, 1, 2)]
    assert at[0] == at[1] != at[2]
    order = [d for d, _ in sorted(at[0].items(), key=lambda i: i[1])]
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.06
    assert x.write_shards(docs.limit(0), Scratch(spark).path("shards"), 4).count() == 0
