"""WARC, language, toxicity, Jaccard, embeddings, chat and the pipeline against brute force."""

import collections
import hashlib
import io
import json
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, jaccard, langid, neardup, toxicity, warc
from tessera.llm.common import components, shared_dir

from .conftest import odd_documents, prose


# -- components --


def find_all(edges, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    return {x: find(x) for x in nodes}


def test_components(spark, work):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (5000, 4000), (5000, 4000)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df, work).collect()}
    want = find_all(edges, {x for e in edges for x in e})
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert components(df.limit(0), work + "-none").count() == 0


# -- WARC --


def test_bundle_frames_stand_alone():
    out = io.BytesIO()
    w = warc.BundleWriter(out, 500, 3)
    data = [bytes([65 + k % 26]) * (k * 7 % 300) for k in range(60)]
    places = [(*w.add(x), len(x)) for x in data]
    w.close()
    r = warc.BundleReader(io.BytesIO(out.getvalue()))
    for k in (59, 0, 31, 30, 58, 1):
        assert r.record(*places[k]) == data[k]
    assert len(r.sizes) > 3


def test_warc(spark, work):
    long = "<p>" + "é" * 100
    rows = [(5, "http://a b/", long), (3, None, long), (9, "u", long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", long), (8, "u", "x" * 200_000), (7, "u", "y" * 100), (10, "u", "y" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit(1).alias("size"), F.lit(1).alias("first")).repartition(3)
    index = warc.write_bundles(df, work, frame_bytes=1000)
    got = sorted(tuple(r) for r in warc.read_records(index).select(F.coalesce("page_id", F.lit(-1)), "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())

    def want(page, _, html):
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        refers = min(same) if len(b) >= 100 and len([1 for _, _, h in rows if (h or "") == (html or "")]) > 1 and page != min(same) else None
        return (-1 if page is None else page, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", -1 if refers is None else refers)

    assert got == sorted(want(*r) for r in rows)
    one = warc.read_records(index.where("page_id = 8")).collect()
    assert len(one) == 1 and one[0].payload_bytes == 200_000
    assert warc.read_records(warc.write_bundles(df.limit(0), work + "-none")).count() == 0


# -- language --


def test_kneser_ney_sums_to_one():
    code, _, _ = langid.grams([prose(1, 400)])
    u, n = np.unique(code, return_counts=True)
    k = langid.KneserNey(u, n)
    contexts = np.unique(u >> np.uint64(16))[:20]
    for c in contexts.tolist():
        own = np.array([(c << 16) | z for z in range(1 << 16)], np.uint64)
        assert abs(k.prob(own, 4).sum() - 1) < 1e-6


def test_table_finds_all():
    codes = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64))
    t = langid.Table(codes)
    at = t.find(codes)
    assert (at >= 0).all() and (codes[t.order][at] == codes).all()
    assert (t.find(codes + np.uint64(1 << 61)) == -1).all()


def test_lookup_agrees_with_the_model():
    texts = {"aa": prose(1, 300), "bb": "der die das und nicht ein eine " * 40}
    counts = {}
    for k, t in texts.items():
        c, n = np.unique(langid.grams([t])[0], return_counts=True)
        counts[k] = (c, n)
    model = langid.build(counts)
    code, _, _ = langid.grams(["alpha und zzz qqq omega"])
    lp = langid.log_probs(model, code)
    for j, lang in enumerate(model["langs"]):
        assert np.allclose(lp[:, j], np.log(langid.KneserNey(*counts[lang]).prob(code, 4)), atol=1e-4)


def test_language_frames(spark, odd, none, work):
    model = langid.fit(odd, work)
    rows = langid.predict(odd, model)
    assert [c for c in rows.columns if c not in ("lang_pred", "lang_score", "lang_rejected")] == [c for c in odd.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    for r in rows.collect():
        letters = any(ch.isalpha() for ch in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.lang_score <= 1
        assert not (r.lang_rejected is False and not letters)
    assert langid.predict(none, model).count() == 0
    empty = langid.fit(none, work + "-none")
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_language_model_keeps_every_gram(spark, work):
    """A language of more than 100 000 distinct 4-grams: the model, its mean and its spread are those of all counts."""
    import zlib

    rng = np.random.default_rng(6)
    texts = ["".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 4000)) for _ in range(60)] + [prose(k, 200) for k in range(60)]
    rows = [(k, t, "zz") for k, t in enumerate(texts)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), work)
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5]
    u, n = np.unique(langid.grams(train)[0], return_counts=True)
    assert len(u) > 150_000 and len(model["grams"][4][0].hash) == len(u)
    want = langid.build({"zz": (u, n)})
    assert np.allclose(model["spread"], want["spread"], rtol=1e-9)
    assert np.array_equal(model["grams"][4][1], want["grams"][4][1])


def test_language_held_out(spark, sf, work):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs, work)).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert sum(r.lang_rejected for r in rows) <= 0.02 * len(rows)


def test_language_rejection_is_calibrated(spark, work):
    """The bound is that of texts which the first model has not counted; held-out texts stay, others go."""
    import math
    import random
    import zlib

    rows = [(k, prose(k, 20 + k % 60), "xx") for k in range(400)] + [(400 + k, "".join(reversed(prose(k, 30 + k % 50))), "yy") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, work, keep=0.9, margin=0.3)
    crc = {d: zlib.crc32(str(d).encode()) for d, _, _ in rows}
    fold = [r for r in rows if crc[r[0]] % 5 and crc[r[0]] // 5 % 8 == 0]
    rest = {x: np.unique(langid.grams([t for d, t, y in rows if y == x and crc[d] % 5 and crc[d] // 5 % 8])[0], return_counts=True) for x in ("xx", "yy")}
    first = langid.build(rest)
    assert len(fold) > 50
    multiples = []
    for _, t, _ in fold:
        code, _, _ = langid.grams([t])
        h = -langid.log_probs(first, code).astype(float).mean(0)
        mean, dev = first["spread"][int(h.argmin())]
        multiples.append((h.min() - 6 * dev / math.sqrt(len(code))) / mean)
    want = sorted(math.ceil(x * 100) for x in multiples)[math.ceil(0.9 * len(fold)) - 1] / 100 + 0.3
    assert abs(model["bound"] - want) < 0.0101
    out = random.Random(3)
    junk = ["".join(out.choice("bcdfghjklmnpqrstvwxyz ") for _ in range(400)) for _ in range(50)]
    _, _, rejected, _ = langid.classify(model, [t for d, t, _ in rows if crc[d] % 5 == 0])
    assert not rejected.any()
    assert langid.classify(model, junk)[2].all()


# -- toxicity --


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = [], []
    for k in range(600):
        text = prose(k, 80)
        bad = k % 4 == 0
        if bad:
            text = text.replace(" ", " vilewordish ", 1) + " nastything."
        if k % 7 == 0:
            text += " the women spoke"
        docs.append((k, text))
        labels.append((k, 1 if bad else 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0), (1, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity(spark, toxic, odd, none, work):
    docs, labels = toxic
    model = toxicity.fit(docs, labels, work)
    held = toxicity.score(docs, model).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()
    assert held and all(r.toxic_predicted == (1 if r.doc_id % 4 == 0 else 0) for r in held)
    for r in toxicity.score(odd, model).collect():
        assert 0 <= r.toxic_score <= 1 and r.toxic_predicted == 0
    assert toxicity.score(none, model).count() == 0
    assert {r.toxic_score for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0), work + "-none")).collect()} == {1 / (1 + np.exp(40))}


def test_identity_terms_move_the_score_alike():
    """With the penalty, a term that occurs in toxic texts only weighs what its unseen counterparts do."""
    rng = np.random.default_rng(0)
    y = (np.arange(400) % 2).astype(float)
    row, col = [], []
    for k in range(400):
        if y[k] and rng.random() < 0.9:
            row.append(k), col.append(0)  # the true sign
        if y[k] and rng.random() < 0.8:
            row.append(k), col.append(1)  # a group, mentioned in toxic texts only
    row, col = np.array(row), np.array(col)
    swaps = [(np.array([1]), np.array([2])), (np.array([1]), np.array([3]))]
    free, _ = toxicity.fit_weights(400, row, col, y, 4, [], 1e-4, 0.0, 60)
    bound, _ = toxicity.fit_weights(400, row, col, y, 4, swaps, 1e-4, 5.0, 60)
    gap = lambda w: abs(w[1] - (w[2] + w[3]) / 2)
    assert gap(bound) < 0.35 * gap(free) and bound[0] > 1


# -- Jaccard --


def brute_sets(rows, k=3):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()))
    return out


def brute_links(sets, percent):
    return [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]


def check_jaccard(spark, rows, work, df=None, percent=90):
    df = df if df is not None else spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = brute_sets(rows)
    want = find_all(brute_links(sets, percent), {d for d, _ in rows if d is not None})
    got = jaccard.join(df, work, percent=percent).collect()
    assert len(got) == len(rows)
    size = dict(sets)
    for r in got:
        assert r.n_shingles == len(size[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])


def test_jaccard_odd(spark, odd, none, work):
    check_jaccard(spark, [(d, t) for d, t, _, _ in odd_documents()], work, odd)
    assert jaccard.join(none, work + "-none").count() == 0


def edited(seed, words, edits):
    import random

    r, w = random.Random(seed), list(words)
    for _ in range(edits):
        k = r.randrange(len(w))
        if r.random() < 0.5:
            w[k] = f"e{r.randrange(10**6)}"
        elif r.random() < 0.5:
            del w[k]
        else:
            w.insert(k, f"i{r.randrange(10**6)}")
    return " ".join(w)


def test_jaccard_near_the_threshold(spark, work, monkeypatch):
    """Sizes from 1 to 200 words and edits around one in thirty: links just above and below the threshold."""
    monkeypatch.setattr(jaccard, "TILE_DOCS", 8)  # so that a group is cut into bands and chunks
    rows, k = [], 0
    for n in (1, 2, 3, 4, 5, 9, 10, 12, 19, 20, 25, 40, 64, 100, 200):
        words = [f"w{n}x{j}" for j in range(n)]
        rows.append((k, " ".join(words)))
        k += 1
        for e in range(1, max(2, n // 12)):
            for s in range(4):
                rows.append((k, edited(k, words, e)))
                k += 1
    rows += [(k + j, edited(j, [f"g{i}" for i in range(90)], 1 + j % 3)) for j in range(60)]
    check_jaccard(spark, rows, work)


def test_kept_shingles_share_one_for_every_link(spark, work):
    """What `shared` gives back, against brute force, and a task that sends in several rounds."""
    rows = [(j, edited(j, [f"w{j // 5}x{i}" for i in range(3 + j)] + ["a", "b", "c", "d"], 1)) for j in range(60)] + [(None, "a b c d"), (70, None), (71, "a b c d"), (72, "A b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [s for _, _, found in jaccard._sets(pa.array([t for d, t in rows if d is not None]), 3) for s in found]
    for percent in (60, 90):
        sent = [(int(jaccard.fingerprint(s)), s[: max(int(np.searchsorted(s, jaccard.ceiling(percent))), jaccard.needed(len(s), percent))]) for s in sets if len(s)]
        of = collections.defaultdict(set)
        for f, s in sent:
            for x in s.tolist():
                of[x].add(f)
        want = {((x ^ (1 << 63)) - (1 << 64) if x ^ (1 << 63) >= 1 << 63 else x ^ (1 << 63), f) for x, own in of.items() if len(own) > 1 for f in own}
        assert want and {(r.key, r.f1) for r in jaccard.shared(df, percent, 3).collect()} == want


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**64, 9000, dtype=np.uint64)
    for _ in range(60):
        n = int(rng.choice([3, 100, 300, 1000, 4000]))
        sets = [np.unique(rng.choice(pool, int(n * rng.uniform(0.7, 1)))) for _ in range(6)]
        size, maps = np.array([len(x) for x in sets]), [jaccard.bitmap(x) for x in sets]
        for percent in (5, 50, 80):
            want = {frozenset((x, y)) for x in range(6) for y in range(x) if 100 * len(np.intersect1d(sets[x], sets[y])) >= percent * len(np.union1d(sets[x], sets[y]))}
            for given in (None, sets):
                edges, label = jaccard.tile_links(size, maps, given, np.full(6, -1), percent)
                assert all(label[x] == label[y] for x, y in want)
                if given is not None:
                    assert {frozenset(e) for e in edges} <= want


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 5), (40, 2)])
def test_jaccard_of_chains(spark, work, monkeypatch, percent, k):
    """Large groups whose centres reach few members: texts that slide over a long one, with a passage that unlike texts share."""
    monkeypatch.setattr(jaccard, "TILE_DOCS", 6)
    monkeypatch.setattr(jaccard, "STARS", 2)
    long = [f"s{j}" for j in range(200)]
    passage = [f"v{j}" for j in range(30)]
    rows = [(j, " ".join(long[2 * j : 2 * j + 70])) for j in range(60)]
    rows += [(100 + j, " ".join(passage + [f"u{j}t{i}" for i in range(j % 20)])) for j in range(50)]
    rows += [(200 + j, " ".join(long[j * 9 : j * 9 + 70 + j])) for j in range(12)]
    sets = brute_sets(rows, k)
    want = find_all(brute_links(sets, percent), {d for d, _ in rows})
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), work, percent=percent, k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets}


def test_jaccard_of_five_words(spark, work, monkeypatch):
    """The pipeline's figures; texts that differ by up to a quarter in size link across the bands of a large group."""
    monkeypatch.setattr(jaccard, "TILE_DOCS", 8)
    rows, k = [], 0
    for n in (1, 4, 5, 6, 9, 12, 20, 40, 64, 100, 200):
        words = [f"w{n}x{j}" for j in range(n)]
        for e in range(max(2, n // 12)):
            for s in range(4):
                rows.append((k, edited(k, words, e)))
                k += 1
    for g in range(40):  # added text at the threshold and just beyond it
        own = [f"p{g}y{j}" for j in range(60 + g)]
        for extra in (0, (len(own) - 4) // 4, (len(own) - 4) // 4 + 1):
            rows.append((k, " ".join(own + [f"t{g}z{extra}q{j}" for j in range(extra)])))
            k += 1
    base = [f"c{j}" for j in range(80)]
    rows += [(k + j, " ".join(base + [f"d{i}" for i in range(j)])) for j in range(0, 60, 19)]
    rows += [(k + 100 + j, edited(j, base, 1 + j % 3)) for j in range(40)]
    sets = brute_sets(rows, 5)
    want = find_all(brute_links(sets, 80), {d for d, _ in rows})
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), work, percent=80, k=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets}


# -- embeddings --


def check_vectors(spark, rows, work, tile_rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("rep"), F.lit(1).alias("good"), F.lit(1).alias("m")).repartition(3)
    ok = [v is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for i, v in rows]
    unit = [np.array(np.array(v, np.float32), float) / np.linalg.norm(np.array(np.array(v, np.float32), float)) if g else None for (_, v), g in zip(rows, ok)]
    links, edges = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                links[i] += 1
                links[j] += 1
                edges.append((rows[i][0], rows[j][0]))
    comp = find_all(edges, {i for i, _ in rows if i is not None})
    got = collections.Counter(tuple(r) for r in neardup.join(df, work, tile_rows=tile_rows).collect())
    assert got == collections.Counter((i, n, None if i is None else comp[i], i is not None and comp[i] == i) for (i, _), n in zip(rows, links))


@pytest.mark.parametrize("tile_rows", [4, 4096])
def test_embeddings(spark, work, tile_rows):
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for c in rng.normal(size=(12, 10)):
        for _ in range(6):
            rows.append((k, [float(x) for x in (c + rng.normal(size=10) * rng.choice([0.02, 0.15, 0.3])).astype(np.float32)]))
            k += 1
    rows += [(k + j, rows[3][1]) for j in range(5)]
    rows += [(200, None), (201, []), (202, [0.0] * 10), (203, [1.0, None]), (204, [float("nan")] * 10), (205, [float("inf")] * 10), (206, [1.0, 0.0]), (207, [2.0, 0.0]), (None, rows[0][1]), (208, [1e-30] * 10), (209, [5.0] * 10)]
    check_vectors(spark, rows, work, tile_rows)


def test_embeddings_empty(spark, work):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neardup.join(none, work).count() == 0


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 80, (2, 60))
    at, low = neardup.forest(80, i, j)
    want = find_all(zip(i.tolist(), j.tolist()), set(range(80)))
    got = {x: x for x in range(80)} | dict(zip(at.tolist(), low.tolist()))
    assert got == want


# -- chat --


def test_chat(spark, work):
    call = lambda *calls: json.dumps({"content": None, "tool_calls": list(calls)})
    rows = [
        (1, 0, "user", "hi \"there\"\n"),
        (1, 2, "assistant", call({"id": "b", "name": "search", "arguments": {"query": "${a}"}}, {"id": "a", "function": {"name": "calculator", "arguments": "{\"expression\": \"1+1\"}"}})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "2"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "x"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "x"})),
        (2, 0, "assistant", call({"id": "a", "name": "search", "arguments": {"limit": 0}}, {"id": "c", "name": "none", "arguments": {}})),
        (2, 1, "assistant", call({"id": "p", "name": "search", "arguments": {"query": "${q}"}}, {"id": "q", "name": "search", "arguments": {"query": "${p}"}})),
        (3, 0, "assistant", "{not json"),
        (3, 1, "assistant", None),
        (3, 2, None, ""),
        (None, None, "user", "x"),
        (4, 0, "user", "same"),
        (4, 0, "user", "same"),
    ]
    schemas = {"search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}}, "calculator": {"type": "object", "required": ["expression"]}}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit("x").alias("json"), F.lit("x").alias("kind"), F.lit("x").alias("row"))
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(df, work, schemas).collect()}
    assert got[1, 0].json == '{"content":"hi \\"there\\"\\n","role":"user","turn":0}'
    r = got[1, 2]
    assert (r.n_calls, r.n_answered, r.n_invalid, r.cyclic) == (2, 2, 0, False)
    assert [c["id"] for c in json.loads(r.json)["tool_calls"]] == ["a", "b"]
    early, late, lost = got[1, 1], got[1, 3], got[1, 4]
    assert (early.order_turn, early.order_step, early.linked) == (2, 1, True)
    assert (late.order_turn, late.order_step, late.linked) == (3, 0, True) and not lost.linked
    assert (got[2, 0].n_invalid, got[2, 0].n_answered) == (2, 0) and got[2, 1].cyclic
    assert all(got[3, k].kind == "plain" for k in range(3)) and got[None, None].kind == "plain"
    assert chat.format_chats(df, work + "-again", schemas).count() == len(rows)
    assert chat.format_chats(df.limit(0), work + "-none").count() == 0


# -- pipeline --


def test_pipeline_stages(spark, odd, none, sf):
    import corpus_pipeline as p

    for docs in (odd, none):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
    kept = collections.Counter(r.doc_id for r in p.jaccard_stage(spark, odd, sf).collect())
    rows = [(d, t) for d, t, _, _ in odd_documents()]
    comp = find_all(brute_links(brute_sets(rows), 90), {d for d, _ in rows if d is not None})
    assert kept == collections.Counter({d: 1 for d, _ in rows if d is None or comp[d] == d})
    assert p.packing_stage(spark, odd, sf).count() > 0


def test_pipeline_drops_near_copies(spark, sf):
    """Two scattered word edits, or an eighth of added text, in 100 words: Jaccard below 0.9 on 3 words, above 0.8 on 5."""
    import corpus_pipeline as p

    words = [f"w{j}" for j in range(100)]
    twice = ["x" if j in (30, 70) else w for j, w in enumerate(words)]
    other = [f"v{j}" for j in range(100)]
    texts = [words, twice, other, other + [f"u{j}" for j in range(13)], [w if j % 20 else "y" for j, w in enumerate(other)]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in p.jaccard_stage(spark, docs, sf).collect()) == [0, 2, 4]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    ids = {r.doc_id for r in p.run(spark, sf).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    comp = {r.doc_id: r.component_id for r in jaccard.join(docs, shared_dir(spark)).collect()}
    clean = [d for d in comp if comp[d] == d and labels.get(d) == 0]
    assert ids and sum(d in ids for d in clean) >= 0.98 * len(clean)


def test_feature_hash_ignores_place():
    a = toxicity.doc_features(pa.array(["Hello, worlds of toxicity"]))[1]
    b = toxicity.doc_features(pa.array(["x", "toxicity!", "hello"]))[1]
    assert len(np.intersect1d(a, b)) == 6  # two words, their beginnings of 4 bytes, of 5 and 6 of the longer


def test_bitmap_parts_the_rows(spark, work):
    from tessera.llm.common import bit_table, by_bits

    df = spark.range(3000).select((F.col("id") * 7 - 500).alias("k")).unionAll(spark.createDataFrame([(None,)], "k long"))
    bits = bit_table(df.where("k % 2 = 0"), "k", work)
    yes, no = by_bits(df, "k", bits, True), by_bits(df, "k", bits, False)
    assert yes.count() + no.count() == df.count()
    assert no.where("k % 2 = 0").count() == 0 and no.where("k % 2 <> 0").count() >= 1490
    assert by_bits(df, "k", bit_table(df.limit(0), "k", work + "-none"), True).count() == 0


# -- hostile JSON --


def test_hostile_json(spark, work):
    deep = "[" * 100_000
    call = lambda arguments: '{"tool_calls": [{"id": "a", "name": "search", "arguments": ' + arguments + "}]}"
    texts = [call('"' + deep + '"'), call('{"query": "x", "limit": ' + "9" * 400 + "}"), call('{"query": "\\ud800"}'), call('{"query": NaN}'), call('{"query": 1e999}'), call('{"query": ' + deep), call('{"query": ' + "9" * 5000 + "}"), '{"tool_calls": [{"id": "\\udc00", "name": "\\udfff"}]}', '{"tool_calls": 3}', "{"]
    df = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    schemas = {"search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}}}
    rows = {r.turn: r for r in chat.format_chats(df, work, schemas).collect()}
    assert [rows[k].kind for k in range(len(texts))] == ["call", "call", "call", "plain", "plain", "plain", "plain", "call", "plain", "plain"]
    assert rows[0].n_invalid == 1 and rows[1].n_invalid == 0 and "\\ud800" in rows[2].json
    for r in rows.values():
        json.loads(r.json, parse_constant=lambda x: pytest.fail(x))


def test_calls_in_topological_order():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        calls = [{"id": str(k), "name": "f", "arguments": [f"${{{r}}}" for r in rng.integers(0, n + 2, int(rng.integers(0, 2))).tolist()]} for k in range(n)]
        out, cyclic = chat.ordered(calls)
        needs = {c["id"]: {r for r in chat.REFERENCE.findall(json.dumps(c["arguments"])) if int(r) < n} for c in calls}
        want, done = [], set()
        while nxt := next((c for c in calls if c["id"] not in done and needs[c["id"]] <= done), None):
            want.append(nxt)
            done.add(nxt["id"])
        assert (out, cyclic) == ((want, False) if len(want) == n else (calls, True))


def test_letters_outside_the_first_plane():
    """They share no code with letters below, and long texts are judged by all their letters."""
    code, row, n = langid.grams(["\U00020000\U00020001 \U0001f642", "一"])
    assert n.tolist() == [2, 1] and not set((code[row == 0] & np.uint64(0xFFFF)).tolist()) & set(range(0x3400, 0xD800))
    counts = {x: np.unique(langid.grams([t])[0], return_counts=True) for x, t in {"aa": "abab " * 50, "bb": "baba acac " * 30}.items()}
    model = langid.build(counts)
    short, long = (langid.classify(model, ["abab " * k])[1][0] for k in (1, 200))
    assert 0.5 < short < long <= 1


# -- toxicity against brute force --


def test_toxic_scores_by_brute_force():
    from tessera.llm.textops import BREAK, Words

    words = ["badword", "awful", "nasty"]
    keys = Words(pa.array(words), lower=True, breaks=BREAK).hashes()
    order = np.argsort(keys)
    weight = dict(zip(words, (2.5, -1.0, 0.75)))
    model = {"keys": keys[order], "weights": np.array([weight[words[k]] for k in order]), "bias": -0.4}
    texts = ["", None, "Badword badword!", "awful,nasty", "badwordish awfully", "NASTY " * 5000 + "x", "é badword-awful 9"]
    got = toxicity.score_texts(pa.array(texts), model, toxicity.Lookup(model["keys"]))
    for t, g in zip(texts, got):
        s = -0.4 + sum(weight[w] for w in set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())) if w in weight)
        assert abs(g - 1 / (1 + np.exp(-s))) < 1e-9


def test_penalty_spares_neutral_mentions(spark, work):
    """A group mostly named in toxic texts: neutral mentions score lower with the penalty, toxic ones stay found."""
    import random
    import zlib

    r = random.Random(5)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        text = prose(k, 12) + (" " + r.choice(["vilescum", "filthrat", "dumbtrash"]) if toxic and k % 6 else "")
        text += " women" if (toxic and k % 9) or k % 50 == 1 else " men" if k % 20 == 2 else ""
        rows.append((k, text))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [prose(5000 + k, 12) + " women" for k in range(50)]
    insults = [prose(6000 + k, 12) + " men vilescum filthrat" for k in range(50)]
    score = {}
    for penalty in (0.0, 50.0):
        model = toxicity.fit(docs, marks, f"{work}/{penalty}", counterfactual=penalty, l2=1e-3)
        lookup = toxicity.Lookup(model["keys"])
        score[penalty] = [toxicity.score_texts(pa.array(t), model, lookup) for t in (neutral, insults)]
    false_alarms = [(score[p][0] >= 0.5).mean() for p in (0.0, 50.0)]
    assert score[50.0][0].mean() < score[0.0][0].mean() and false_alarms[1] <= false_alarms[0]
    assert score[50.0][1].min() > score[50.0][0].max()
