"""Embedding near-duplicates: exact cosine self-join by PCA-ordered tiles.

Vectors are scaled to length one and turned onto the eigenvectors of their second-moment
matrix (its d x d sums cover all rows). Two vectors of cosine t or more lie within
sqrt(2 - 2 t) of each other in every coordinate, so after ordering by the leading components
only tiles whose bounding boxes come that near meet. In a pair of tiles the leading
dimensions are accumulated first; the rest of a product is at most the product of the
suffix norms, and a pair is dropped as soon as its sum plus that bound stays below t.
Survivors near the threshold are computed again from the original vectors.

Equal vectors are one row with a multiplicity (partial aggregation, so a hot vector never
meets itself), tiles are bounded in rows, and a pair of tiles returns link counts and a
spanning forest, never its links. No vector set is collected or broadcast.

Defined results: a vector that is null, empty, zero, or holds a null, NaN or infinite
component links with nothing, is its own component and is kept; vectors of different length
never link; a null vec_id links with nothing and has a null component; repeated rows count
as separate vectors; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, remove, ship

BOXES = 4  # leading coordinates in a tile's bounding box
SLACK = 1e-9


def unit(block: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one."""
    x = block.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) of the components of links i - j among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def tile_pair(a: np.ndarray, b: np.ndarray, same: bool, basis: np.ndarray, t: float, weight_a: np.ndarray, weight_b: np.ndarray, block: int = 1024):
    """Weighted link counts of the rows of a and of b, and star edges over 0..len(a)+len(b) (b's rows follow a's).

    same: a and b are one tile; each unordered pair counts once for either row.
    """
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ basis, ub @ basis
    d = basis.shape[1]
    steps = sorted({min(8, d), min(24, d), d})
    tails = [(np.sqrt(np.maximum((ra[:, k:] ** 2).sum(1), 0)), np.sqrt(np.maximum((rb[:, k:] ** 2).sum(1), 0))) for k in steps]
    count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    left, right = [], []
    for p in range(0, len(a), block):
        for q in range(p if same else 0, len(b), block):
            x, y = slice(p, p + block), slice(q, q + block)
            k = steps[0]
            part = ra[x, :k] @ rb[y, :k].T
            i, j = np.nonzero(part + np.outer(tails[0][0][x], tails[0][1][y]) >= t - SLACK)
            if same and p == q:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i) * 8 > part.size and k < d:  # many survive: whole products are cheaper
                part = ra[x] @ rb[y].T
                keep = part[i, j] >= t - SLACK
                i, j = i[keep], j[keep]
                value = part[i, j]
                i, j = i + p, j + q
            else:
                value = part[i, j]
                i, j = i + p, j + q
                for s in range(1, len(steps)):
                    value = value + np.einsum("ij,ij->i", ra[i, steps[s - 1] : steps[s]], rb[j, steps[s - 1] : steps[s]])
                    keep = value + tails[s][0][i] * tails[s][1][j] >= t - SLACK
                    i, j, value = i[keep], j[keep], value[keep]
            near = np.abs(value - t) < 1e-10
            if near.any():
                va, vb = a[i[near]].astype(np.float64), b[j[near]].astype(np.float64)
                value[near] = (va * vb).sum(1) / (np.sqrt((va * va).sum(1)) * np.sqrt((vb * vb).sum(1)))
            keep = value >= t
            i, j = i[keep], j[keep]
            if len(i):
                count_a += np.bincount(i, weights=weight_b[j], minlength=len(a)).astype(np.int64)
                count_b += np.bincount(j, weights=weight_a[i], minlength=len(b)).astype(np.int64)
                u, v = forest(len(a) + len(b), i, (j if same else j + len(a)))
                left.append(u)
                right.append(v)
    if left:
        u, v = forest(len(a) + len(b), np.concatenate(left), np.concatenate(right))
    else:
        u = v = np.zeros(0, np.int64)
    return count_a, count_b, u, v


def _moments(reps: DataFrame) -> dict[int, np.ndarray]:
    """Second-moment matrix of the unit vectors, by vector length."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, rows in _by_length(b.column("embedding")):
                u = unit(rows[1])
                total[dim] = total.get(dim, 0) + u.T @ u
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.reshape(-1))], ["dim", "at", "value"])

    rows = reps.select("embedding").mapInArrow(run, "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).collect()  # dim * dim numbers
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["at"]] = r["value"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in out.items()}


def _by_length(col):
    """(length, (row numbers, matrix)) of an Arrow list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield int(dim), (at, flat[off[at][:, None] + np.arange(dim)])


def join(vectors: DataFrame, workdir: str, threshold: float = 0.95, tile_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)["embedding"]
    number = "float" if kind == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    good = F.expr("coalesce(vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0), false)")
    v = v.withColumn("good", good).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    slim = materialise(v.select("vec_id", "good", "h1", "h2"), f"{workdir}/slim")
    reps = materialise(v.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding")), f"{workdir}/reps")
    bases = _moments(reps)
    if not bases:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
    width = float(np.sqrt(2 - 2 * threshold)) + SLACK
    shared = spark.sparkContext.broadcast(bases)  # dim * dim numbers per length

    def place(batches):
        for b in batches:
            for dim, (at, rows) in _by_length(b.column("embedding")):
                c = unit(rows) @ shared.value[dim][:, :2]
                key = np.floor(c[:, 0] / width) * 4 + (c[:, 1] if dim > 1 else 0)
                yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(at)), b.column("m").take(pa.array(at)), pa.array(np.full(len(at), dim), pa.int32()), pa.array(key), pa.array([r.tobytes() for r in rows], pa.binary())], ["rep", "m", "dim", "key", "vec"])

    placed = materialise(reps.select("rep", "m", "embedding").mapInArrow(place, "rep long, m long, dim int, key double, vec binary"), f"{workdir}/placed")
    sizes = {r["dim"]: r["n"] for r in placed.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    most = max(sizes.values())
    cuts = max(1, -(-most // tile_rows))
    if cuts > 1:
        marks = placed.groupBy("dim").agg(F.percentile_approx("key", [k / cuts for k in range(1, cuts)], 20 * cuts).alias("q")).collect()
        marks = {r["dim"]: np.array(r["q"]) for r in marks}
    else:
        marks = {}
    marks_shared = spark.sparkContext.broadcast(marks)

    def number_tiles(batches):
        for b in batches:
            dims, keys = b.column("dim").to_numpy(), b.column("key").to_numpy()
            tile = np.zeros(len(b), np.int64)
            for dim in np.unique(dims):
                at = dims == dim
                tile[at] = np.searchsorted(marks_shared.value.get(int(dim), np.zeros(0)), keys[at], side="left")
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("m"), b.column("dim"), pa.array(tile), b.column("vec")], ["rep", "m", "dim", "tile", "vec"])

    numbered = placed.mapInArrow(number_tiles, "rep long, m long, dim int, tile long, vec binary")
    numbered = materialise(numbered, f"{workdir}/numbered")
    # ties of the key can overfill a tile: such tiles are cut further by a hash
    fills = materialise(numbered.groupBy("dim", "tile").agg(F.ceil(F.count("*") / (2 * tile_rows)).alias("parts")), f"{workdir}/fills")
    numbered = numbered.join(fills, ["dim", "tile"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))

    dtype = np.float32 if number == "float" else np.float64

    def build(key, t):
        dim = t.column("dim")[0].as_py()
        order = np.argsort(t.column("rep").to_numpy())
        t = t.take(pa.array(order))
        data = b"".join(t.column("vec").to_pylist())
        c = unit(np.frombuffer(data, dtype).reshape(-1, dim)) @ shared.value[dim][:, :BOXES]
        box = np.concatenate([c.min(0), np.zeros(BOXES - c.shape[1]), c.max(0), np.zeros(BOXES - c.shape[1])])
        name = (key[0].as_py(), key[1].as_py(), key[2].as_py())
        return pa.table({"dim": pa.array([name[0]], pa.int32()), "tile": pa.array([name[1]], pa.int64()), "part": pa.array([name[2]], pa.int64()), "box": pa.array([box.tolist()], pa.list_(pa.float64())), "ids": [t.column("rep").to_numpy().astype("<i8").tobytes()], "weights": [t.column("m").to_numpy().astype("<i8").tobytes()], "data": [data]})

    tiles = numbered.select("dim", "tile", "part", "rep", "m", "vec").groupBy("dim", "tile", "part").applyInArrow(build, "dim int, tile long, part long, box array<double>, ids binary, weights binary, data binary")
    tiles = materialise(tiles, f"{workdir}/tiles")

    # tiles meet where their ranges of the first coordinate share a cell or touch the next
    meta = tiles.select("dim", F.struct("tile", "part").alias("id"), "box").withColumn("lo", F.floor(F.expr("box[0]") / width)).withColumn("hi", F.floor(F.expr(f"box[{BOXES}]") / width))
    left = meta.select("dim", F.col("id").alias("p"), F.col("box").alias("pb"), F.explode(F.sequence("lo", "hi")).alias("cell"))
    right = meta.select("dim", F.col("id").alias("q"), F.col("box").alias("qb"), F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("cell"))
    gap = "aggregate(transform(sequence(0, {n} - 1), k -> pow(greatest(0D, pb[k] - qb[k + {n}], qb[k] - pb[k + {n}]), 2)), 0D, (s, x) -> s + x)".format(n=BOXES)
    pairs = left.join(right, ["dim", "cell"]).where("p <= q").where(f"{gap} <= {width * width + SLACK}").select("dim", "p", "q").distinct()
    pairs = materialise(pairs, f"{workdir}/pairs")

    def side(name: str) -> DataFrame:
        return tiles.select("dim", F.struct("tile", "part").alias(name), F.col("ids").alias(f"{name}_ids"), F.col("weights").alias(f"{name}_w"), F.col("data").alias(f"{name}_data"))

    work = pairs.join(side("p"), ["dim", "p"]).join(side("q"), ["dim", "q"])

    def compare(batches):
        for b in batches:
            for k in range(len(b)):
                get = lambda c, k=k, b=b: b.column(c)[k].as_py()
                dim, same = get("dim"), get("p") == get("q")
                pi, qi = np.frombuffer(get("p_ids"), "<i8"), np.frombuffer(get("q_ids"), "<i8")
                pw, qw = np.frombuffer(get("p_w"), "<i8"), np.frombuffer(get("q_w"), "<i8")
                p = np.frombuffer(get("p_data"), dtype).reshape(-1, dim)
                q = np.frombuffer(get("q_data"), dtype).reshape(-1, dim)
                ca, cb, u, v = tile_pair(p, q, same, shared.value[dim], threshold, pw, qw)
                ids = np.concatenate([pi, qi])
                if same:
                    nodes, counts = pi, ca + cb
                else:
                    nodes, counts = ids, np.concatenate([ca, cb])
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(len(at), bool), np.ones(len(u), bool)])), pa.array(np.concatenate([nodes[at], ids[u]])), pa.array(np.concatenate([counts[at], ids[v]]))], ["edge", "a", "b"])

    found = materialise(work.select("dim", "p", "q", "p_ids", "p_w", "p_data", "q_ids", "q_w", "q_data").mapInArrow(compare, "edge boolean, a long, b long"), f"{workdir}/found")
    counts = materialise(found.where("not edge").groupBy("a").agg(F.sum("b").alias("n")).select(F.col("a").alias("rep"), "n"), f"{workdir}/counts")
    comps = materialise(components(found.where("edge").select("a", "b"), f"{workdir}/links"), f"{workdir}/comps").select(F.col("node").alias("rep"), "component")
    names = materialise(reps.select("h1", "h2", "rep", "m"), f"{workdir}/names").withColumn("good", F.lit(True))
    for done in ("reps", "placed", "numbered", "fills", "tiles", "pairs", "found"):
        remove(spark, f"{workdir}/{done}")  # the result reads none of them
    out = slim.join(names, ["good", "h1", "h2"], "left").join(counts, "rep", "left").join(comps, "rep", "left")
    out = out.select("vec_id", F.coalesce(F.col("m") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
