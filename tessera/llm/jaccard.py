"""Exact Jaccard self-join on word shingles, without emitting all pairs.

Steps, all over whole texts:

1. `features`: the distinct k-word shingle hashes of every text give its size n and a 128-bit
   fingerprint. Copies collapse: sets equal in fingerprint are one node from here on.
2. `shared`: two sets that link share at least ceil(n t) shingles, so in any common order the
   first p = n - ceil(n t) + 1 of each hold a common one. A shingle that one set alone has can
   stand first without harm. Every text sends its shingles below a fixed hash (SPREAD times
   the share of p), and its first p by hash at least, to where the hash is counted; what comes
   back are the shingles of more than one set.
3. A text whose u unshared shingles below that hash are p or more links with nothing. Of the
   others the first p - u shared shingles by hash are kept: passages that many documents share
   do no harm as long as a text has enough words of its own. The holders of a kept shingle are
   a list; lists with equal holders are one.
4. Only the holders' texts are read again (a bitmap of fixed size sorts most others out before
   the join) into a table of sets and hashed bitmaps.
5. Holders of a list meet in tiles. Bit counts of the bitmaps bound an overlap from above; a
   tile returns a spanning forest of the pairs whose bound reaches the threshold. Components
   of these forests are the candidate groups (a superset of the links).
6. A group's sets meet in tiles: the same bound, then exact intersection of sorted arrays.
   Pairs already connected are skipped, and a tile returns a spanning forest of its links. The
   components of these links, with the copies joined back, are the result.

A list or group goes to one tile. A large one first meets its STARS centres (bounded tiles,
linear in its size); of the components this makes, the members of the group's largest need
no comparison among themselves. What is left is cut by size band (ratio just above 100 / t,
only equal and adjacent bands meet) and into chunks, and each pair of chunks, unless both are
of the largest component, is a tile of bounded size.

Hot shingles, fingerprints and nodes: a task sends a shingle once however many of its texts
hold it, aggregations combine on the map side, and joins read tables from shared storage on
both sides so that the adaptive skew join can split a hot key.

Defined results: null or empty text, or one without words: no shingles, linked with nothing,
component = its own doc_id. A null doc_id links with nothing and has a null component.
Repeated rows give repeated result rows. Other columns are ignored. An empty table gives no
rows. Very long texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, by_bits, components, enter, materialise, remove, ship, trim
from .textops import U, Words, mix, shingles, slices

FEATURES = "doc_id long, n_shingles long, n_low long, f1 long, f2 long"
SPREAD = 1.75  # shingles sent for each that a prefix needs
HOLD = 1 << 21  # shingles that a task holds before it sends them
TOP = U(1 << 63)
TILE_DOCS, TILE_SHINGLES, STARS = 512, 1 << 21, 8


def _sets(col, k: int):
    """(row range, shingle sets) of a text column, in slices of bounded size."""
    for lo, hi in slices(col):
        yield lo, hi, shingles(Words(col.slice(lo, hi - lo), lower=True), k)


def ceiling(percent: int) -> np.uint64:
    """Shingles with hashes below it are sent by every text that has them."""
    return U(min((1 << 64) - 1, int(SPREAD * (100 - percent) / 100 * (1 << 64))))


def fingerprint(s: np.ndarray) -> np.int64:
    return mix(s).sum(dtype=U).view(np.int64)


def needed(size, percent: int):
    """Length of a prefix that holds a common shingle of every two sets that link."""
    return size - -(-size * percent // 100) + 1


def features(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """FEATURES of every document."""
    limit = ceiling(percent)

    def run(batches):
        enter("jaccard")
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text")
            for lo, hi, sets in _sets(text, k):
                low = [int(np.searchsorted(s, limit)) for s in sets]
                f1 = [fingerprint(s) for s in sets]
                f2 = [fingerprint(s ^ U(0xD6E8FEB86659FD93)) for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in ([len(s) for s in sets], low, f1, f2))], ["doc_id", "n_shingles", "n_low", "f1", "f2"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, FEATURES)


def _grouped(key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by key, where each key's pairs begin, and how many they are."""
    order = np.lexsort((f, key))
    key, f = key[order], f[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (f[1:] != f[:-1])
    key, f = key[new], f[new]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key, f, start, np.diff(np.r_[start, len(key)])


def shared(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """(key, f1): the shingles that several sets have, with these sets, among those that texts send.

    key orders as a signed number like the hash does unsigned. Rows may repeat.
    """
    limit = ceiling(percent)
    parts = 64
    while parts < 2 * docs._jdf.queryExecution().toRdd().getNumPartitions():
        parts *= 2

    def send(batches):
        enter("jaccard")
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush():
            key, f, start, n = _grouped(np.concatenate(keys), np.concatenate(owners))
            keys.clear()
            owners.clear()
            several = n > 1
            own = np.repeat(several, n)
            # known to be shared: the pairs pass on as they are, and one tells the others
            for kind, at in ((2, np.flatnonzero(own)), (1, start[several]), (0, start[~several])):
                part = (mix(key[at]) & U(parts - 1)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                at, part = at[order], part[order]
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
                for a, b in zip(cut, [*cut[1:], len(part)]):
                    yield int(part[a]), kind, key[at[a:b]].tobytes(), f[at[a:b]].tobytes()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "keys", "owners"])

        held = 0
        for b in batches:
            for _, _, sets in _sets(b.column("text"), k):
                sent = [s[: max(int(np.searchsorted(s, limit)), needed(len(s), percent))] for s in sets if len(s)]
                if sent:
                    keys.append(np.concatenate(sent))
                    owners.append(np.repeat(np.array([fingerprint(s) for s in sets if len(s)], np.int64), [len(s) for s in sent]))
                    held += len(keys[-1])
                if held >= HOLD:
                    rows, held = list(flush()), 0
                    yield batch()
        if held and (rows := list(flush())):
            yield batch()
        rows = []
        trim()

    def meet(batches):
        enter("jaccard")
        now, held = None, {0: [], 1: [], 2: []}

        def finish():
            key, f, start, n = _grouped(*(np.concatenate([p[c] for kind in (0, 1) for p in held[kind]] or [np.zeros(0, t)]) for c, t in ((0, U), (1, np.int64))))
            told = np.unique(np.concatenate([p[0] for p in held[1]])) if held[1] else np.zeros(0, U)
            hit = np.repeat((n > 1) | np.isin(key[start], told), n)
            key, f = (np.concatenate([x, *(p[c] for p in held[2])]) for c, x in ((0, key[hit]), (1, f[hit])))
            for x in held.values():
                x.clear()
            for a in range(0, len(key), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array((key[a : a + (1 << 18)] ^ TOP).view(np.int64)), pa.array(f[a : a + (1 << 18)])], ["key", "f1"])

        for b in batches:
            for part, kind, keys, owners in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "keys", "owners"))):
                if part != now:
                    yield from finish()
                    now = part
                held[kind].append((np.frombuffer(keys, U), np.frombuffer(owners, np.int64)))
        yield from finish()
        trim()

    sent = docs.where("doc_id is not null").selectExpr("cast(text as string) text").mapInArrow(send, "part int, kind int, keys binary, owners binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, f1 long")


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set as 64-bit words: the least power of two of bits that is twice its size, 256 to 8192."""
    width = 256
    while width < 1 << 13 and width < 2 * len(s):
        width *= 2
    bits = np.zeros(width, bool)
    bits[(mix(s) & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


class Unions:
    """Labels of the components of a few nodes."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: int, y: int) -> bool:
        if self.label[x] == self.label[y]:
            return False
        self.label[self.label == self.label[y]] = self.label[x]
        return True


def tile_links(sizes: np.ndarray, maps: list[np.ndarray], sets: list[np.ndarray] | None, side: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(spanning forest, component labels) of a tile's rows.

    Rows of side -1 meet all others, rows of the sides 0 and 1 only those of another side. With
    sets, pairs whose Jaccard reaches the threshold are connected; without, those whose bitmaps allow it.
    """
    found, out = Unions(len(sizes)), []
    order = np.argsort(sizes, kind="stable")
    size, own_side, label = sizes[order], side[order], found.label
    # a bitmap's width rises with the size, so equal widths lie side by side
    wide = np.array([len(maps[k]) for k in order])
    starts = np.flatnonzero(np.r_[True, wide[1:] != wide[:-1]]) if len(order) else []
    runs = [(int(a), int(b), int(wide[a]), np.stack([maps[k] for k in order[a:b]])) for a, b in zip(starts, [*starts[1:], len(order)])]
    for x in range(1, len(order)):
        me = order[x]
        low = int(np.searchsorted(size[:x], -(-size[x] * percent // 100)))
        for begin, end, width, block in runs:
            y = np.arange(max(low, begin), min(x, end))
            y = y[label[order[y]] != label[me]]
            if own_side[x] != -1:
                y = y[own_side[y] != own_side[x]]
            if not len(y):
                continue
            a, b = np.bitwise_or.reduce(maps[me].reshape(-1, width), axis=0), block[y - begin]
            bound = np.minimum(size[x] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), size[y] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
            y = y[(100 + percent) * bound >= percent * (size[x] + size[y])]
            while len(y):
                now, y = y[:16], y[16:]
                if sets is not None:
                    own = sets[me]
                    flat = np.concatenate([sets[k] for k in order[now]])
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    both = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[now])[:-1]]))
                    now = now[100 * both >= percent * (size[x] + size[now] - both)]
                for k in order[now]:
                    if found.join(int(me), int(k)):
                        out.append((int(me), int(k)))
                y = y[label[order[y]] != label[me]]
    return out, label


def _meet(rows: DataFrame, percent: int, exact: bool, star: bool) -> DataFrame:
    """Edges (a, b) of rows (tile, side, doc_id, n_shingles, map[, shingles]), a tile's rows together.

    A spanning forest of a tile's links; star: rows of side 1 are centres, and every link of a
    centre counts.
    """
    columns = ["tile", "side", "doc_id", "n_shingles", "map"] + ["shingles"] * exact

    def run(batches):
        enter("jaccard")
        held: list[tuple] = []
        edges: list[tuple] = []

        def finish():
            if len(held) > 1:
                side, ids, size = (np.array([h[c] for h in held], np.int64) for c in range(3))
                maps = [np.frombuffer(h[3], np.uint64) for h in held]
                sets = [np.frombuffer(h[4], U) for h in held] if exact else None

                def links(at: np.ndarray, who: np.ndarray) -> None:
                    forest, _ = tile_links(size[at], [maps[k] for k in at], [sets[k] for k in at] if exact else None, who, percent)
                    edges.extend((int(ids[at[x]]), int(ids[at[y]])) for x, y in forest)

                if star:
                    centres, rest = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
                    links(centres, np.full(len(centres), -1))
                    for c in centres:
                        links(np.append(rest, c), np.append(np.zeros(len(rest), np.int64), 1))
                else:
                    links(np.arange(len(held)), side)
            held.clear()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])
            edges.clear()
            return out

        now = None
        for b in batches:
            for tile, *row in zip(*(b.column(c).to_pylist() for c in columns)):
                if tile != now:
                    finish()
                    now = tile
                held.append(tuple(row))
            if edges:
                yield batch()
        finish()
        if edges:
            yield batch()
        trim()

    return rows.select(columns).repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def _forests(cand: DataFrame, sets: DataFrame, at: str, percent: int, exact: bool) -> DataFrame:
    """Forest edges (a, b) among the holders cand (grp, doc_id, f1, n_shingles) of each group."""
    payload = sets.select("doc_id", "f1", "map", *(["shingles"] if exact else []))
    weight = F.col("n_shingles") if exact else F.lit(0).cast("long")
    cand = materialise(cand, f"{at}/cand")
    groups = materialise(cand.groupBy("grp").agg(F.count("*").alias("g_docs"), F.sum(weight).alias("g_weight")), f"{at}/groups")
    cut = F.greatest(F.ceil(F.col("g_docs") / TILE_DOCS), F.ceil(F.col("g_weight") / TILE_SHINGLES))
    cand = cand.join(groups.select("grp", cut.alias("cuts")), "grp")
    small = cand.where("cuts <= 1").select(F.xxhash64("grp").alias("tile"), F.lit(-1).alias("side"), "doc_id", "f1", "n_shingles")
    edges = _meet(small.join(payload, ["doc_id", "f1"]), percent, exact, False)
    if groups.where(cut > 1).isEmpty():
        return edges
    large = materialise(cand.where("cuts > 1").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("cuts"))), f"{at}/large")
    # centres: of each of STARS parts of a group by hash, the one with the least other hash
    least = large.groupBy("grp", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(STARS)).alias("k")).agg(F.min(F.struct(F.xxhash64(F.lit(2), "doc_id").alias("h"), "doc_id", "f1", "n_shingles", "cuts")).alias("c"))
    centres = materialise(least.select("grp", "c.doc_id", "c.f1", "c.n_shingles", "c.cuts"), f"{at}/centres")
    tile = F.xxhash64("grp", "chunk").alias("tile")
    holders = large.join(centres.select("grp", "doc_id", "f1"), ["grp", "doc_id", "f1"], "left_anti").select(tile, F.lit(0).alias("side"), "doc_id", "f1", "n_shingles")
    stars = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select(tile, F.lit(1).alias("side"), "doc_id", "f1", "n_shingles")
    edges = materialise(edges.unionByName(_meet(holders.unionByName(stars).join(payload, ["doc_id", "f1"]), percent, exact, True)), f"{at}/edges")
    found = materialise(components(edges, f"{at}/near"), f"{at}/found").select(F.col("node").alias("doc_id"), "component")
    large = materialise(large.select("grp", "doc_id", "f1", "n_shingles").join(found, "doc_id", "left"), f"{at}/placed")
    parts = large.groupBy("grp", "component").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("all"), F.max(F.when(F.col("component").isNotNull(), F.struct("n", "component"))).alias("top"))
    parts = materialise(parts.where("top is null or top.n < all").select("grp", F.col("top.component").alias("main")), f"{at}/open")  # the others are one component
    large = large.join(parts, "grp").withColumn("main", F.coalesce(F.col("component") == F.col("main"), F.lit(False))).withColumn("band", F.floor(F.log("n_shingles") / F.log(F.lit(100.8 / percent))).cast("int"))
    large = materialise(large.drop("component"), f"{at}/rest")
    if large.isEmpty():
        return edges
    cells = materialise(large.groupBy("grp", "band", "main").agg(F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum(weight) / TILE_SHINGLES)).alias("own")), f"{at}/cells")
    chunks = cells.select("grp", "band", "main", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("chunk"))
    left, right = (chunks.select("grp", F.col("band").alias(f"band_{s}"), F.col("main").alias(f"main_{s}"), F.col("chunk").alias(f"chunk_{s}")) for s in "pq")
    # every two cells of equal or adjacent bands once
    meets = left.join(right, "grp").where("band_p in (band_q, band_q - 1) and not (main_p and main_q) and (band_p < band_q or main_p < main_q or (main_p = main_q and chunk_p <= chunk_q))")
    meets = materialise(meets.withColumn("tile", F.xxhash64("grp", "band_p", "main_p", "chunk_p", "band_q", "main_q", "chunk_q")), f"{at}/meets")
    alone = "band_p = band_q and main_p = main_q and chunk_p = chunk_q"
    ends = meets.select("grp", F.col("band_p").alias("band"), F.col("main_p").alias("main"), F.col("chunk_p").alias("chunk"), "tile", F.expr(f"case when {alone} then -1 else 0 end").alias("side"))
    ends = ends.unionByName(meets.where(f"not ({alone})").select("grp", F.col("band_q").alias("band"), F.col("main_q").alias("main"), F.col("chunk_q").alias("chunk"), "tile", F.lit(1).alias("side")))
    placed = large.join(cells, ["grp", "band", "main"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("own")))
    rows = placed.select("grp", "band", "main", "chunk", "doc_id", "f1", "n_shingles").join(ends, ["grp", "band", "main", "chunk"]).select("tile", "side", "doc_id", "f1", "n_shingles")
    return edges.unionByName(_meet(rows.join(payload, ["doc_id", "f1"]), percent, exact, False))


def join(docs: DataFrame, workdir: str, percent: int = 90, k: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Two documents link when 100 * |A and B| >= percent * |A or B| (percent 1 to 100) over their
    sets of k-word shingles (A-Z lower-cased). Intermediate tables go below `workdir` (shared storage).
    """
    if not 1 <= percent <= 100 or k < 1:
        raise ValueError("percent must lie in 1..100, and k be 1 at least")
    ship(docs.sparkSession)
    slim = materialise(features(docs, percent, k), f"{workdir}/features")
    reps = materialise(slim.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "n_low", "f1", "f2").agg(F.min("doc_id").alias("rep")), f"{workdir}/reps")

    known = materialise(shared(docs, percent, k), f"{workdir}/shared")
    mine = known.groupBy("f1").agg(F.sort_array(F.collect_set("key")).alias("keys")).join(reps, "f1")  # no more keys than the text has shingles
    low = int((ceiling(percent) ^ TOP).view(np.int64))
    want = f"n_shingles - (n_shingles * {percent} + 99) div 100 + 1 - (n_low - below)"  # p - u
    mine = mine.withColumn("below", F.size(F.filter("keys", lambda x: x < F.lit(low)))).withColumn("want", F.expr(want))
    mine = mine.where("want > 0").select(F.explode(F.expr("case when below >= want then slice(keys, 1, cast(want as int)) else keys end")).alias("key"), "f1", "rep", "n_shingles")
    held = materialise(mine, f"{workdir}/held")
    # lists of equal holders, by two sums of 32-bit hashes, are one
    low32 = 0xFFFFFFFF
    sums = [F.sum(F.xxhash64(F.lit(s), "f1").bitwiseAND(F.lit(low32).cast("long"))).alias(f"s{s}") for s in (0, 1)]
    lists = held.groupBy("key").agg(F.count("*").alias("n"), *sums, F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").groupBy("n", "s0", "s1", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    holders = held.join(materialise(lists, f"{workdir}/lists"), "key").select(F.col("key").alias("grp"), F.col("rep").alias("doc_id"), "f1", "n_shingles")
    holders = materialise(holders, f"{workdir}/holders")

    wanted = materialise(holders.select("doc_id").distinct(), f"{workdir}/wanted")
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    texts = by_bits(texts, "doc_id", bit_table(wanted, "doc_id", f"{workdir}/wanted-bits"), True).join(wanted, "doc_id", "left_semi")

    def build(batches):
        enter("jaccard")
        for b in batches:
            for lo, hi, found in _sets(b.column("text"), k):
                rows = [(doc, len(s), fingerprint(s), bitmap(s).tobytes(), s.tobytes()) for doc, s in zip(b.column("doc_id").slice(lo, hi - lo).to_pylist(), found) if len(s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "n_shingles", "f1", "map", "shingles"])

    # a doc_id may stand at several texts: the set meant is the one of its node
    sets = texts.mapInArrow(build, "doc_id long, n_shingles long, f1 long, map binary, shingles binary")
    sets = materialise(sets.join(holders.select("doc_id", "n_shingles", "f1").distinct(), ["doc_id", "n_shingles", "f1"], "left_semi").dropDuplicates(["doc_id", "f1"]), f"{workdir}/sets")

    near = materialise(_forests(holders, sets, f"{workdir}/near", percent, False), f"{workdir}/near-edges")
    groups = components(near, f"{workdir}/near-cc").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))
    cand = groups.join(holders.select("doc_id", "f1", "n_shingles").distinct(), "doc_id")
    links = materialise(_forests(cand, sets, f"{workdir}/exact", percent, True), f"{workdir}/links")
    comps = materialise(components(links, f"{workdir}/final"), f"{workdir}/comps").select(F.col("node").alias("rep"), "component")
    for done in ("shared", "held", "lists", "holders", "wanted", "wanted-bits", "sets", "near", "near-edges", "exact", "links"):
        remove(docs.sparkSession, f"{workdir}/{done}")  # the result reads none of them
    out = slim.join(reps.drop("n_low"), ["n_shingles", "f1", "f2"], "left").join(comps, "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
