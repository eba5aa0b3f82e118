"""Near duplicates among embeddings by product quantisation.

A coarse quantiser files every vector under its nearest centroid; what is left of it is coded by
subspace. A query visits the lists whose cells come near enough, scores the codes there by table
look-ups against its own uncoded residual, and checks what the look-up distance allows by exact cosine.

A neighbour at distance r lies in another cell only if the plane between the two centroids is within
r * cos(a) of the query, where a is the angle between their difference and the plane's normal; its
look-up distance depends on such an angle too. In d dimensions the cosine of an angle between unrelated
directions spreads by 1 / sqrt(d), so both cuts allow a share of r, at least `spread` / sqrt(d). Vectors that
fill fewer dimensions than they have, all together or each group in its own, need a larger share: it is
measured on the sample, as what near pairs there need. A share of 1 is the triangle inequality and loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pack, release
from .components import components

EPS = 1e-5
#: Queries of the sample whose neighbours the share is measured on, neighbours of each, and of all those pairs the
#: part that the share must suffice for; it is then raised by MARGIN.
MEASURED, NEIGHBOURS, SUFFICES, MARGIN = 1024, 16, 0.999, 1.15
#: Vectors of lengths that few have are compared with all others of their length, one task for each length.
FEW = 2000
#: Vectors of a list, on average, as long as the sample has SAMPLE_LIST vectors for each list.
LIST_MEAN, SAMPLE_LIST = 256, 8
#: Entries of a list that one task holds; longer lists are split and each part is visited.
LIST_ROWS = 4000
#: Queries of a cell that one task holds; more of them are split too, and each block meets every part.
ASK_ROWS = 16000
#: Numbers gathered at once for exact cosines, and queries scored at once.
GATHER, ASK_STEP = 1 << 20, 256


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)[0]
        order = np.argsort(near, kind="stable")
        kinds, first, count = np.unique(near[order], return_index=True, return_counts=True)
        centres[kinds] = np.add.reduceat(x[order], first, axis=0) / count[:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre of each row, and all squared distances."""
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0)
    return d.argmin(1), d


@dataclass
class Quantiser:
    """Coarse centroids, and for each slice of the dimensions a codebook of residuals."""

    coarse: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, subspaces) and the distance between each residual and its code."""
        codes = np.zeros((len(residual), len(self.books)), np.uint8)
        left = np.zeros(len(residual))
        for j, book in enumerate(self.books):
            near, d = _nearest(residual[:, self.cuts[j] : self.cuts[j + 1]], book)
            codes[:, j] = near
            left += d[np.arange(len(near)), near]
        return codes, np.sqrt(left)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each query's slice to every code of a subspace, in single precision."""
        out = []
        for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False):
            x, book = residual[:, a:b].astype(np.float32), book.astype(np.float32)
            d = x @ (book.T * np.float32(-2))
            d += (book**2).sum(1)
            d += (x**2).sum(1)[:, None]
            out.append(d)
        return out


def train(x: np.ndarray, lists: int, subspaces: int = 8, codes: int = 256, seed: int = 1) -> Quantiser:
    """Centroids in two levels, each of about the square root of their number, then codebooks."""
    rng = np.random.default_rng(seed)
    top = _kmeans(x, max(1, round(lists**0.5)), rng)
    near = _nearest(x, top)[0]
    coarse = [_kmeans(x[near == k], max(1, round(lists * (near == k).mean())), rng) for k in range(len(top)) if (near == k).any()]
    coarse = np.concatenate(coarse)
    some = x[rng.choice(len(x), min(len(x), 40 * codes), replace=False)]
    residual = some - coarse[_nearest(some, coarse)[0]]
    cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int).tolist()
    return Quantiser(coarse, cuts, [_kmeans(residual[:, a:b], codes, rng, 6) for a, b in zip(cuts, cuts[1:], strict=False)])


def needed_share(q: Quantiser, x: np.ndarray, spread: float) -> float:
    """The share of a distance that both cuts must allow so that near pairs of the sample x are found.

    A pair's share does not depend on its distance's scale, so each query's nearest neighbours tell it whether or
    not they are near enough to link. It is spread / sqrt(dimensions) at least and 1 at most.
    """
    least = min(1.0, spread / x.shape[1] ** 0.5)
    if least == 1 or len(x) < 2:
        return least
    near, far = _nearest(x, q.coarse)
    residual = x - q.coarse[near]
    codes, error = q.encode(residual)
    coded = q.coarse[near] + np.concatenate([book[codes[:, j]] for j, book in enumerate(q.books)], 1)
    gaps = np.sqrt(_nearest(q.coarse, q.coarse)[1])
    need = []
    for i in range(0, min(len(x), MEASURED), 64):
        ask = np.arange(i, min(i + 64, len(x), MEASURED))
        d = 2 - 2 * x[ask] @ x.T
        d[np.arange(len(ask)), ask] = np.inf
        k = min(NEIGHBOURS, len(x) - 1)
        row, col = np.repeat(np.arange(len(ask)), k), np.argpartition(d, k - 1, axis=1)[:, :k].ravel()
        r = np.sqrt(np.maximum(d[row, col], 0))
        row, col, r = row[r > 1e-6], col[r > 1e-6], r[r > 1e-6]
        own, other = near[ask[row]], near[col]
        gap = np.where(own == other, 1.0, gaps[own, other])
        probe = np.where(own == other, 0.0, (far[ask[row], other] - far[ask[row], own]) / (2 * r * np.maximum(gap, 1e-12)))
        looked = ((x[ask[row]] - coded[col]) ** 2).sum(1)
        table = (looked - r**2 - error[col] ** 2) / np.maximum(2 * r * error[col], 1e-12)
        need.append(np.maximum(probe, np.where(error[col] > 1e-9, table, 0.0)))
    need = np.concatenate(need)
    return float(min(1.0, max(least, MARGIN * np.quantile(need, SUFFICES)))) if len(need) else least


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each one's group) after u and v of each link come into one group."""
    u, v = label[u], label[v]
    u, v = np.divmod(np.unique(u[u != v] * len(label) + v[u != v]), len(label))
    while len(u):
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, max_sample: int = 32768, spread: float = 3.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Two vectors link if their cosine in double precision is at least threshold. n_links counts the
    other vectors linked directly, component_id is the smallest vec_id reachable, kept marks it.
    Vectors that are null or zero or hold null or non-finite components link with nothing; so do rows
    with a null vec_id, whose component is null. Vectors link only with those of their own length.
    Equal vectors are one entry with a count, so copies of any number are not expanded into pairs.
    Rows that repeat a vec_id are vectors of their own, which count as each other's links if they are
    near. An empty table gives no rows; extra columns are ignored. The quantiser learns from at most
    max_sample distinct vectors, those with the smallest hash; all are indexed and all are queries.
    Every pair reported is checked exactly; `spread` sets the least share of lists that is visited (see above),
    and the square root of the length makes the search exact. Vectors of a length that at most FEW have are
    compared exactly.
    """
    scratch = Scratch(vectors.sparkSession)
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & _usable(v.cast("array<double>"))
    base = vectors.select("vec_id", v.alias("v"), usable.alias("usable"))
    good = base.where("usable").select("vec_id", "v")
    classes = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    alone = base.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    widths = {r["width"]: r["n"] for r in classes.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    rare = [w for w, n in widths.items() if n <= FEW]
    found = scratch.save(_exact(classes.where(F.size("v").isin(rare)), threshold), "rare") if rare else None
    for width, total in sorted(widths.items()):
        if width in rare:
            continue
        some = _search(classes.where(F.size("v") == width), width, total, threshold, max_sample, spread, scratch)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return alone
    groups = components(found.where("edge").select(F.col("id").alias("a"), "b"), scratch)
    links = found.where("not edge").groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.select("v", "id", "rep", "n").join(links, "id", "left").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = told.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = told.join(least, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    out = good.join(told, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


def _folded(ids: np.ndarray, links: np.ndarray, names: np.ndarray, label: np.ndarray) -> pa.Table:
    """Rows (id, links, -1, false) of the links of ids, and (name, 0, its group's first name, true) of what they connect."""
    linked, other = links > 0, label != np.arange(len(names))
    rep, size = np.concatenate([ids[linked], names[other]]), int(linked.sum())
    return pa.table({"id": pa.array(rep, pa.int64()), "links": pa.array(np.concatenate([links[linked], np.zeros(other.sum(), np.int64)]), pa.int64()), "b": pa.array(np.concatenate([np.full(size, -1), names[label[other]]]), pa.int64()), "edge": pa.array(np.arange(len(rep)) >= size)})


def _exact(classes: DataFrame, threshold: float) -> DataFrame:
    """As _search, for lengths of few vectors each: all of one length in one task, by cosine alone."""

    def compare(table: pa.Table) -> pa.Table:
        ids, count = table["id"].to_numpy(), table["n"].to_numpy()
        x = _matrix(table["v"], len(table["v"][0]))
        norm = np.linalg.norm(x, axis=1)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        order = np.argsort(ids)
        ids, count, x, norm = ids[order], count[order], x[order], norm[order]
        for i in range(0, len(ids), ASK_STEP):
            near = x[i : i + ASK_STEP] @ x.T / (norm[i : i + ASK_STEP, None] * norm) >= threshold
            near[np.arange(len(near)), i + np.arange(len(near))] = False
            links[i : i + len(near)] = near @ count
            row, col = np.nonzero(near)
            label = joined(label, i + row, col)
        return _folded(ids, links, ids, label)

    return classes.withColumn("width", F.size("v")).groupBy("width").applyInArrow(compare, "id long, links long, b long, edge boolean")


def _search(classes: DataFrame, width: int, total: int, threshold: float, max_sample: int, spread: float, scratch: Scratch) -> DataFrame:
    """(id, links, b, edge): for classes (id, n, v) of one length, how many vectors of other classes
    each links to, in parts to be summed, and edges (id, b) that connect what is linked.
    """
    sample = _matrix(classes.orderBy(F.xxhash64("v"), "id").limit(max_sample).select("v").toArrow()["v"], width)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    quantiser = train(sample, max(1, min(total // LIST_MEAN, len(sample) // SAMPLE_LIST)))
    held = classes.sparkSession.sparkContext.broadcast(quantiser)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    reach = needed_share(quantiser, sample, spread)
    raw = classes.schema["v"].dataType.elementType.simpleString()
    dtype = np.float32 if raw == "float" else np.float64

    def assign(batches):
        q = held.value
        gaps = np.sqrt(_nearest(q.coarse, q.coarse)[1])
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            near, d = _nearest(u, q.coarse)
            codes, error = q.encode(u - q.coarse[near])
            probe = d - d[np.arange(len(u)), near][:, None] <= 2 * reach * radius * gaps[near] + EPS
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(probe.sum(1))]), pa.int32()), pa.array(np.nonzero(probe)[1], pa.int32()))
            out = [batch.column("id"), batch.column("n"), pa.array(near, pa.int32()), lists, pa.array([pack(c) for c in codes], pa.binary()), pa.array(error), pa.array([pack(r) for r in x.astype(dtype)], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "n", "cell", "probes", "codes", "error", "x"])

    filed = scratch.save(classes.select("id", "n", "v").mapInArrow(assign, "id long, n long, cell int, probes array<int>, codes binary, error double, x binary"), "filed")
    probed = filed.select(F.explode("probes").alias("cell"), "id", "n", "x")

    # a row for each list, of which there are at most max_sample / SAMPLE_LIST
    parts = lambda table, rows, name: F.broadcast(table.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(name)))
    sizes = parts(filed, LIST_ROWS, "split"), parts(probed, ASK_ROWS, "deal")
    split, deal = F.col("split"), F.col("deal")
    mine = lambda n: F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    entries = filed.join(sizes[0], "cell").join(sizes[1], "cell").select("cell", mine(split).alias("part"), every(deal).alias("block"), F.lit(False).alias("query"), "id", "n", "codes", "error", "x")
    asks = probed.join(sizes[0], "cell").join(sizes[1], "cell").select("cell", every(split).alias("part"), mine(deal).alias("block"), F.lit(True).alias("query"), "id", "n", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), "x")

    def search(table: pa.Table) -> pa.Table:
        q = held.value
        ask = table["query"].to_numpy(zero_copy_only=False)
        ids, count = table["id"].to_numpy(), table["n"].to_numpy()
        x = np.frombuffer(b"".join(table["x"].to_pylist()), dtype).reshape(-1, width).astype(np.float64)
        e, a = np.flatnonzero(~ask), np.flatnonzero(ask)
        links = np.zeros(len(a), np.int64)
        # links join labels block by block and go out as each vector's smallest one reached in here, so rows bound them
        names, spot = np.unique(ids, return_inverse=True)
        label = np.arange(len(names))
        if len(e) and len(a):
            codes = np.frombuffer(b"".join(table["codes"].take(pa.array(e)).to_pylist()), np.uint8).reshape(len(e), -1).T.astype(np.intp)
            error = table["error"].to_numpy()[e]
            limit = (radius**2 + error**2 + 2 * reach * radius * error + EPS).astype(np.float32)
            norm = np.linalg.norm(x, axis=1)
            centre = q.coarse[table["cell"][0].as_py()]
            for i in range(0, len(a), ASK_STEP):
                part = a[i : i + ASK_STEP]
                tables = q.tables(x[part] / norm[part][:, None] - centre)
                half = (len(tables) + 1) // 2
                # half of the slices rule most entries out already
                far = sum(np.take(t, code, axis=1) for t, code in zip(tables[:half], codes[:half], strict=True))
                rows, cols = np.nonzero(far <= limit[None, :])
                far = far[rows, cols]
                for t, code in zip(tables[half:], codes[half:], strict=True):
                    far += t[rows, code[cols]]
                rows, cols = rows[far <= limit[cols]], cols[far <= limit[cols]]
                step = max(1, GATHER // width)
                for k in range(0, len(rows), step):
                    row, col = rows[k : k + step], cols[k : k + step]
                    m, n = part[row], e[col]
                    cosine = np.einsum("ij,ij->i", x[m], x[n]) / (norm[m] * norm[n])
                    ok = (cosine >= threshold) & (ids[m] != ids[n])
                    np.add.at(links, i + row[ok], count[n[ok]])
                    label = joined(label, spot[m[ok]], spot[n[ok]])
        out = _folded(ids[a], links, names, label)
        if len(ids) > LIST_ROWS:
            release()
        return out

    found = scratch.save(entries.unionByName(asks).groupBy("cell", "part", "block").applyInArrow(search, "id long, links long, b long, edge boolean"), "found")
    scratch.drop(filed)
    return found
