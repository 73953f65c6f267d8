"""Counterfactual-regularised toxicity classifier.

A document is the set of its words and of their 4-, 5- and 6-byte beginnings (64-bit
hashes; several languages build insults from a stem). Learning: on a bounded sample of the
labelled rows, features tied to the toxic label by a binomial z-score are selected and a
logistic model over their presence is fitted. For each sampled document that mentions a
group (an identity term), the term is swapped for the others of the list, and squared
changes of the score are penalised, besides an L2 penalty: mentioning a group moves the
score by about the same, small amount whatever the group, so neutral mentions stay neutral.
Identity terms are always among the features, so that this penalty binds.

The model (at most `max_features` hashes and weights) is shipped to the workers; scoring is
one pass over the text without a shuffle. Only distinct features of a whole text count, so a
long clean text is no likelier to be flagged for its length.

Sample: labelled rows whose hashed doc_id falls below a threshold that gives about
`sample_docs` rows (a documented bound of the fit); nothing else is sampled.

Defined results: null and empty texts get the model's base score; null labels and null
doc_ids teach nothing; where labels repeat a doc_id, the largest toxic value counts; rows
that repeat a document are scored alike; other columns are ignored; without any usable
label the score is 0 for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, enter, materialise, ship, trim
from .textops import BREAK, U, Words, mix, raw, slices

#: Mentions of groups, in the four languages of the corpus; a parameter.
IDENTITY = """women men woman man gay straight lesbian transgender muslim muslims christian christians jew jews jewish
black white asian latino immigrants immigrant refugees disabled old young frauen männer schwule muslime christen juden
schwarze weiße ausländer behinderte femmes hommes musulmans chrétiens juifs noirs blancs immigrés réfugiés mujeres
hombres musulmanes cristianos judíos negros blancos inmigrantes refugiados""".split()

PREFIXES = (4, 5, 6)


def doc_features(col) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and word beginning, repeats included."""
    w = Words(col, lower=True, breaks=BREAK)
    size = w.stop - w.start
    rows, out = [w.row], [w.hashes()]
    for k in PREFIXES:
        at = size > k
        rows.append(w.row[at])
        out.append(mix(w.hashes(w.start[at], w.start[at] + k) + U(k)))
    return np.concatenate(rows), np.concatenate(out)


def distinct_pairs(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


class Lookup:
    """Positions of hashes in a small sorted array, behind a bitmap that rejects most of the others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> U(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, positions in keys) of those found."""
        at = np.flatnonzero(self.seen[(h >> U(44)).astype(np.int64)])
        pos = np.searchsorted(self.keys, h[at])
        hit = (pos < len(self.keys)) & (self.keys[np.minimum(pos, len(self.keys) - 1)] == h[at]) if len(self.keys) else np.zeros(len(at), bool)
        return at[hit], pos[hit]


def identity_features(terms: list[str]) -> list[np.ndarray]:
    """Feature hashes of each term (its own and its beginnings)."""
    row, f = doc_features(pa.array(terms))
    return [np.unique(f[row == k]) for k in range(len(terms))]


def fit_weights(n: int, row: np.ndarray, col: np.ndarray, y: np.ndarray, dims: int, swaps: list[tuple[np.ndarray, np.ndarray]], l2: float, counterfactual: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton's method with conjugate gradients; swaps: (features lost, features gained) per counterfactual."""
    w, bias = np.zeros(dims), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    none = np.zeros(0, np.int64)
    lost = np.concatenate([a for a, _ in swaps]) if swaps else none
    won = np.concatenate([b for _, b in swaps]) if swaps else none
    lost_at = np.repeat(np.arange(len(swaps)), [len(a) for a, _ in swaps]) if swaps else none
    won_at = np.repeat(np.arange(len(swaps)), [len(b) for _, b in swaps]) if swaps else none

    def pull(v):
        """Gradient of the mean squared change of score over the swaps."""
        if not swaps:
            return np.zeros(dims)
        change = np.bincount(lost_at, weights=v[lost], minlength=len(swaps)) - np.bincount(won_at, weights=v[won], minlength=len(swaps))
        change *= counterfactual / len(swaps)
        return np.bincount(lost, weights=change[lost_at], minlength=dims) - np.bincount(won, weights=change[won_at], minlength=dims)

    def value(w, bias):
        s = bias + np.bincount(row, weights=w[col], minlength=n)
        return float((np.logaddexp(0, s) - y * s).mean() + 0.5 * (l2 * w @ w + w @ pull(w)))

    now = value(w, bias)
    for _ in range(steps):
        s = bias + np.bincount(row, weights=w[col], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        g, gb = np.bincount(col, weights=(p - y)[row], minlength=dims) / n + l2 * w + pull(w), float((p - y).mean())
        curve = p * (1 - p) / n + 1e-12
        # the Newton step, by conjugate gradients
        x, xb, r, rb = np.zeros(dims), 0.0, -g, -gb
        d, db, rr = r.copy(), rb, r @ r + rb * rb
        first = rr
        for _ in range(200):
            if rr <= 1e-6 * first or rr < 1e-24:
                break
            t = curve * (db + np.bincount(row, weights=d[col], minlength=n))
            h, hb = np.bincount(col, weights=t[row], minlength=dims) + l2 * d + pull(d), float(t.sum())
            a = rr / (d @ h + db * hb)
            x, xb, r, rb = x + a * d, xb + a * db, r - a * h, rb - a * hb
            new = r @ r + rb * rb
            d, db, rr = r + new / rr * d, rb + new / rr * db, new
        size, slope = 1.0, g @ x + gb * xb
        while size > 1e-6 and value(w + size * x, bias + size * xb) > now + 1e-4 * size * slope:
            size /= 2
        w, bias = w + size * x, bias + size * xb
        before, now = now, value(w, bias)
        if before - now <= 1e-10 * max(1.0, now):
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, workdir: str, sample_docs: int = 12_000, max_features: int = 50_000, z: float = 7.0, l2: float = 5e-7, counterfactual: float = 1.0, steps: int = 40, terms: list[str] | None = None) -> dict:
    """Model dict: keys (sorted feature hashes), weights, bias."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("doc_id is not null and toxic is not null").where(crc_of_id("doc_id") % 3 != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    share = min(1.0, sample_docs / max(total, 1))
    sample = materialise(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))), f"{workdir}/sample")
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(sample), "doc_id")  # about sample_docs pairs of numbers

    def extract(batches):
        enter("toxicity")
        for b in batches:
            text = b.column("text")
            doc, toxic = b.column("doc_id").to_numpy(), b.column("toxic").to_numpy()
            for lo, hi in slices(text):
                row, f = distinct_pairs(*doc_features(text.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][row]), pa.array(toxic[lo:hi][row].astype(np.int32)), pa.array(f.view(np.int64))], ["doc_id", "toxic", "feature"])

    seen = materialise(texts.mapInArrow(extract, "doc_id long, toxic int, feature long"), f"{workdir}/features")
    n, bad = sample.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    if not n or not bad or bad == n:
        return {"keys": np.zeros(0, U), "weights": np.zeros(0), "bias": -50.0 if not bad else 50.0}
    p = bad / n
    own = identity_features(terms if terms is not None else IDENTITY)
    always = np.unique(np.concatenate(own)) if own else np.zeros(0, U)
    counts = seen.groupBy("feature").agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("n1"))
    score = (F.col("n1") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    best = counts.withColumn("z", score).where(f"z >= {z} and n1 >= 4").orderBy(F.desc("z"), "feature").limit(max_features).select("feature")
    picked = np.array([r["feature"] for r in best.collect()], np.int64).view(U)  # at most max_features
    keys = np.unique(np.concatenate([picked, always]))
    names = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "feature long")
    rows = seen.join(F.broadcast(names), "feature").select("doc_id", "feature").distinct().toPandas()  # sample_docs documents, selected features only
    y_of = {r["doc_id"]: int(r["toxic"] > 0) for r in sample.collect()}
    ids = {d: k for k, d in enumerate(sorted(y_of))}
    y = np.array([y_of[d] for d in sorted(y_of)], float)
    row = rows["doc_id"].map(ids).to_numpy(np.int64)
    col = np.searchsorted(keys, rows["feature"].to_numpy(np.int64).view(U))
    place = [np.searchsorted(keys, f) for f in own]
    whole = {int(np.searchsorted(keys, h)): k for k, h in enumerate(Words(pa.array(terms if terms is not None else IDENTITY), lower=True, breaks=BREAK).hashes())}
    swaps = [(place[whole[c]], place[(whole[c] + 1 + (r % (len(own) - 1))) % len(own)]) for r, c in zip(row.tolist(), col.tolist()) if c in whole] if len(own) > 1 else []
    # every term is also swapped once with the next, so that terms the sample lacks stay neutral too
    swaps += [(place[k], place[(k + 1) % len(own)]) for k in range(len(own))]
    w, bias = fit_weights(len(y), row, col, y, len(keys), swaps, l2, counterfactual, steps)
    del rows, row, col, swaps
    trim()
    return {"keys": keys, "weights": w, "bias": bias}


def score_texts(col, model: dict, lookup: Lookup) -> np.ndarray:
    """Score of each text, 0 to 1."""
    row, f = doc_features(col)
    at, pos = lookup(f)
    r, p = distinct_pairs(row[at], pos)
    s = model["bias"] + np.bincount(r, weights=model["weights"][p], minlength=len(col))
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """docs' columns plus toxic_score (double) and toxic_predicted (int), from text alone."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most max_features numbers, twice

    def run(batches):
        enter("toxicity")
        lookup = Lookup(shared.value["keys"])
        for b in batches:
            text = b.column("text").cast(pa.string())
            parts = [score_texts(text.slice(lo, hi - lo), shared.value, lookup) for lo, hi in slices(text)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "toxic_score", "toxic_predicted"])

    own = docs.drop("toxic_score", "toxic_predicted")
    schema = T.StructType([*own.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())])
    return own.mapInArrow(run, schema)
