"""Language identification with interpolated Kneser-Ney character models.

Counting: every training text (lang given) contributes its character 4-grams; counts are
summed over all rows and every counted 4-gram is kept, so the model grows with the distinct
4-grams of the training rows. From them come modified counts of lower orders (number of
distinct left neighbours) and, with one discount D, interpolated probabilities
  p(z | wxy) = max(c - D, 0) / c(wxy.) + D N(wxy.) / c(wxy.) * p(z | xy), and so on.
The log-probabilities of all languages lie in columns beside arrays sorted by hash, one per
order, with the back-off weights of contexts in arrays of their own. A text's characters are
looked up together; its language is the one with the lowest mean cross-entropy. `rejected` is
set when that mean lies too far above the language's own: as a multiple of the mean of its
training text, six standard errors taken off, it exceeds a bound. The bound is calibrated: an
eighth of the training rows is scored by a model of the other seven, and the bound lies
`margin` above the quantile `keep` of what these texts, known to be of a learned language, reach.
The final model counts all training rows. Texts without a letter are rejected too.

Letters are lower-cased, all else is one space. Features come from text alone.

Defined results: null text or text without a letter: `und`, score 0, rejected; ties go to
the first language in sorted order; null lang or null doc_id teaches nothing; repeated rows
count each; very long texts are counted and scored whole; columns named lang_pred, lang_score
or lang_rejected are replaced and the others are kept; with no training row every text is `und`;
with no row to calibrate on, the bound is 1.25 plus the margin.
The score is the language's share of the likelihood of the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, enter, materialise, ship, trim
from .textops import U, mix, slices

ORDER = 4
SPACE = 32
FOLDS = 8  # one of them calibrates
STEP = 0.01  # of the histogram of multiples
ASTRAL = 0xD800  # up to U+F8FF no code point is a letter: letters above U+FFFF share these places, and none with a letter below
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point (below 65536) to itself if a letter, else the space."""
    if not _LETTER:
        _LETTER.append(np.array([c if chr(c).isalpha() else SPACE for c in range(1 << 16)], np.uint16))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram codes, row of each, letters per row); a 4-gram holds four 16-bit characters, the last in the low bits."""
    low = [t.lower() if t else "" for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    joined = "".join(t + "\n" for t in low)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letters()[np.minimum(cp, 0xFFFF)]
    wide = np.flatnonzero(cp > 0xFFFF)
    if len(wide):
        c = c.copy()
        c[wide] = [ASTRAL + x % (0xF900 - ASTRAL) if chr(x).isalpha() else SPACE for x in cp[wide].tolist()]
    row = np.repeat(np.arange(len(texts)), size + 1)
    blank = c == SPACE
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[:1] = ~blank[:1]
    c, row = c[keep].astype(U), row[keep]
    blank = c == SPACE
    code = c.copy()
    begin = np.zeros(len(c), bool)
    begin[:1] = True
    begin[1:] = row[1:] != row[:-1]
    for k in range(1, ORDER):
        left = np.full(len(c), U(SPACE))
        left[k:] = c[:-k] if k < len(c) else left[k:]
        # what lies before a text's first character counts as space
        for j in range(k):
            at = np.flatnonzero(begin) + j
            left[at[at < len(c)]] = SPACE
        code |= left << U(16 * k)
    # a text that is all blank leaves single spaces only
    return code, row, np.bincount(row[~blank], minlength=len(texts))


class Table:
    """Array sorted by hash with columns; `find` gives positions, -1 where absent."""

    BITS = 18

    def __init__(self, codes: np.ndarray):
        h = mix(codes ^ U(0x2545F4914F6CDD1D))
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.first = np.searchsorted(self.hash, np.arange((1 << self.BITS) + 1, dtype=U) << U(64 - self.BITS)).astype(np.int32) if len(h) else np.zeros((1 << self.BITS) + 1, np.int32)
        self.first[-1] = len(h)
        self.deep = int(np.diff(self.first).max(initial=0))

    def find(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), -1, np.int64)
        if not len(self.hash):
            return out
        h = mix(codes ^ U(0x2545F4914F6CDD1D))
        b = (h >> U(64 - self.BITS)).astype(np.int64)
        pos, end = self.first[b].astype(np.int64), self.first[b + 1]
        todo = np.arange(len(codes))
        for _ in range(self.deep):
            live = pos < end
            if not live.all():
                todo, h, pos, end = todo[live], h[live], pos[live], end[live]
            hit = self.hash[pos] == h
            out[todo[hit]] = pos[hit]
            miss = ~hit
            todo, h, pos, end = todo[miss], h[miss], pos[miss] + 1, end[miss]
            if not len(todo):
                break
        return out


def _groups(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their weights."""
    u, inv = np.unique(codes, return_inverse=True)
    return u, np.bincount(inv, weights=weights, minlength=len(u))


def low_bits(code: np.ndarray, order: int) -> np.ndarray:
    return code & U((1 << (16 * order)) - 1) if order < 4 else code


class KneserNey:
    """One language: probabilities of any n-gram from its 4-gram counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, discount: float = 0.75):
        self.d = discount
        self.levels = {}
        c, n = _groups(codes, counts.astype(float))
        for order in range(ORDER, 0, -1):
            ctx, total = _groups(c >> U(16), n)
            _, kinds = _groups(c >> U(16), np.ones(len(c)))
            self.levels[order] = (c, n, ctx, total, kinds)
            c, n = _groups(low_bits(c, order - 1), np.ones(len(c)))  # distinct left neighbours

    @staticmethod
    def _at(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        return p, (keys[p] == x) if len(keys) else np.zeros(len(x), bool)

    def backoff(self, context: np.ndarray, order: int) -> np.ndarray:
        """Weight of the lower order for contexts of order - 1 characters; 1 where unseen."""
        _, _, ctx, total, kinds = self.levels[order]
        p, hit = self._at(ctx, context)
        return np.where(hit, self.d * kinds[p] / total[p], 1.0) if len(ctx) else np.ones(len(context))

    def prob(self, code: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full(len(code), 1.0 / 65536)
        c, n, ctx, total, _ = self.levels[order]
        lower = self.prob(low_bits(code, order - 1), order - 1)
        if not len(c):
            return lower
        p, hit = self._at(c, code)
        q, known = self._at(ctx, code >> U(16))
        own = np.where(hit & known, np.maximum(n[p] - self.d, 0) / total[q], 0.0)
        return own + self.backoff(code >> U(16), order) * lower


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], discount: float = 0.75, bound: float = 1.5) -> dict:
    """Model of all languages from {lang: (4-gram codes, counts)}; bound: see `classify`."""
    langs = sorted(counts)
    own = [KneserNey(*counts[x], discount) for x in langs]
    grams_, backs = {}, {}
    for order in range(ORDER, 0, -1):
        codes = np.unique(np.concatenate([k.levels[order][0] for k in own])) if own else np.zeros(0, U)
        t = Table(codes)
        grams_[order] = (t, np.log(np.stack([k.prob(codes, order) for k in own], 1))[t.order].astype(np.float32) if own else np.zeros((0, 0), np.float32))
        if order > 1:
            codes = np.unique(np.concatenate([k.levels[order][2] for k in own])) if own else np.zeros(0, U)
            t = Table(codes)
            backs[order] = (t, np.log(np.stack([k.backoff(codes, order) for k in own], 1))[t.order].astype(np.float32) if own else np.zeros((0, 0), np.float32))
    spread = []
    for k, x in zip(own, langs):
        c, n = counts[x]
        s = -np.log(k.prob(c, ORDER))
        mean = float((s * n).sum() / n.sum())
        spread.append((mean, float(np.sqrt((n * (s - mean) ** 2).sum() / n.sum()))))
    # the weight of the uniform distribution below order one
    floor = np.array([np.log(k.backoff(np.zeros(1, U), 1)[0] / 65536) for k in own], np.float32)
    return {"langs": langs, "grams": grams_, "backs": backs, "spread": np.array(spread).reshape(-1, 2), "floor": floor, "bound": bound}


def log_probs(model: dict, code: np.ndarray) -> np.ndarray:
    """Log-probability of each 4-gram's last character, a column per language."""
    out = np.zeros((len(code), len(model["langs"])), np.float32)
    todo = np.arange(len(code))
    for order in range(ORDER, 0, -1):
        c = low_bits(code[todo], order)
        t, values = model["grams"][order]
        at = t.find(c)
        hit = at >= 0
        out[todo[hit]] += values[at[hit]]
        todo, c = todo[~hit], c[~hit]
        if not len(todo):
            return out
        if order > 1:
            t, values = model["backs"][order]
            at = t.find(c >> U(16))
            known = at >= 0
            out[todo[known]] += values[at[known]]
    out[todo] += model["floor"]
    return out


def measure(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(lang, score, cross-entropy, its multiple of the training mean with six standard errors taken off) of each text."""
    code, row, n_letters = grams(texts)
    n = np.bincount(row, minlength=len(texts))
    k = len(model["langs"])
    if not k:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    lp = log_probs(model, code)
    total = np.zeros((len(texts), k))
    for j in range(k):
        total[:, j] = np.bincount(row, weights=lp[:, j], minlength=len(texts))
    h = -total / np.maximum(n, 1)[:, None]
    best = h.argmin(1)
    gain = (h - h.min(1, keepdims=True)) * n[:, None]  # the whole text's difference in log-likelihood
    score = 1 / np.exp(-gain).sum(1)
    low = h[np.arange(len(texts)), best]
    mean, dev = model["spread"][best].T
    und = n_letters == 0
    lang = ["und" if u else model["langs"][b] for u, b in zip(und.tolist(), best.tolist())]
    return lang, np.where(und, 0.0, score), low, (low - 6 * dev / np.sqrt(np.maximum(n, 1))) / np.maximum(mean, 1e-9)


def classify(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(lang, score, rejected, cross-entropy) of each text."""
    lang, score, low, multiple = measure(model, texts)
    return lang, score, (np.array(lang, object) == "und") | (multiple > model["bound"]), low


def calibrate(rows: DataFrame, model: dict, keep: float, margin: float) -> float:
    """The bound: margin above the quantile `keep` of the multiples of rows (lang, text), whose 4-grams the model has not counted."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        enter("langid")
        for b in batches:
            given, text = b.column("lang").to_pylist(), b.column("text")
            known, bins = set(shared.value["langs"]), []
            for lo, hi in slices(text):
                lang, _, _, multiple = measure(shared.value, text.slice(lo, hi - lo).to_pylist())
                bins += [int(x) for x, y, z in zip(np.ceil(np.clip(multiple, -10, 10) / STEP).tolist(), lang, given[lo:hi]) if y != "und" and z in known]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64())], ["bin"])
        trim()

    found = sorted((r["bin"], r["count"]) for r in rows.mapInArrow(run, "bin long").groupBy("bin").count().collect())  # at most 2001 bins
    shared.unpersist()
    if not found:
        return 1.25 + margin
    below = np.cumsum([n for _, n in found])
    return found[int(np.searchsorted(below, keep * below[-1]))][0] * STEP + margin


def fit(docs: DataFrame, workdir: str, discount: float = 0.75, keep: float = 0.999, margin: float = 0.25) -> dict:
    """Count the 4-grams of all training rows (crc32(doc_id as text) mod 5 not 0, lang given) and build the model of all of them.

    keep, margin: of the bound for rejection, see above.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(crc_of_id("doc_id") % 5 != 0)
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (F.floor(crc_of_id("doc_id") / 5) % FOLDS == 0).alias("fold"))

    def count(batches):
        enter("langid")
        held: dict[tuple[str, bool], list] = {}

        def merge(key, last):
            parts = held[key]
            if last or len(parts) > 12:
                c, n = _groups(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                parts[:] = [(c, n)]

        def rows_of():
            for key in list(held):
                merge(key, True)
                c, n = held.pop(key)[0]
                n = pa.array(n.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(c)), pa.array(c.view(np.int64)), n, n if key[1] else pa.array(np.zeros(len(c), np.int64))], ["lang", "gram", "n", "held"])

        for b in batches:
            keys, text = list(zip(b.column("lang").to_pylist(), b.column("fold").to_pylist())), b.column("text")
            for lo, hi in slices(text):
                own = text.slice(lo, hi - lo).to_pylist()
                for key in sorted(set(keys[lo:hi])):
                    code, _, _ = grams([t for t, x in zip(own, keys[lo:hi]) if x == key])
                    u, n = np.unique(code, return_counts=True)
                    held.setdefault(key, []).append((u, n.astype(float)))
                    merge(key, False)
                if sum(len(p[0]) for parts in held.values() for p in parts) > 4_000_000:
                    yield from rows_of()
        yield from rows_of()
        trim()

    sums = rows.mapInArrow(count, "lang string, gram long, n long, held long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    sums = materialise(sums, f"{workdir}/grams")
    counts, rest = {}, {}
    for lang in sorted(r["lang"] for r in sums.select("lang").distinct().collect()):
        pdf = sums.where(F.col("lang") == lang).select("gram", "n", "held").toPandas()
        c, n, left = pdf["gram"].to_numpy(np.int64).view(U), pdf["n"].to_numpy(np.int64), (pdf["n"] - pdf["held"]).to_numpy(np.int64)
        if len(c):
            counts[lang] = (c, n)
        if left.any():
            rest[lang] = (c[left > 0], left[left > 0])
    first = build(rest, discount)
    del rest
    bound = calibrate(rows.where("fold").select("lang", "text"), first, keep, margin)
    del first
    model = build(counts, discount, bound)
    trim()
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs' columns plus lang_pred, lang_score, lang_rejected, from text alone; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # grows with the distinct 4-grams, times languages

    def run(batches):
        enter("langid")
        for b in batches:
            text = b.column("text").cast(pa.string())
            lang, score, rejected = [], [], []
            for lo, hi in slices(text):
                x = classify(shared.value, text.slice(lo, hi - lo).to_pylist())
                lang += x[0]
                score.append(x[1])
                rejected.append(x[2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0)), pa.array(np.concatenate(rejected) if rejected else np.zeros(0, bool))], [*b.schema.names, "lang_pred", "lang_score", "lang_rejected"])
        trim()

    own = docs.drop("lang_pred", "lang_score", "lang_rejected")
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]))
