"""SentencePiece, packing, token files and quality rules against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as spm
from tokenizers import Tokenizer

from tessera.llm import packing, quality, sentencepiece, tokenfile
from tessera.llm.tokens import Encoder

from .conftest import odd_documents, prose

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
STRANGE = ["", " ", "  a  b\nc \xe9 ", "\u65e5\u672c\u8a9e x\u2581y", "a" * 100 + "the" * 30, "\t\n", "\U0001f642\U0001f642 z", "don't  stop's", "x\x85y", "A\u0301 e\u0301", "<|endoftext|> hi <|startoftext|>", "\u0130stanbul \u03a3\u0391\u03a3", "\x1cq\x1f", "a\xa0b \u2003 c\u2028d", "\xbd \xb2 \u2167", "...!?;:", "'s 't word's,", "\u1680x\u3000\u200by", prose(9, 200)]


def test_bpe_matches_the_library():
    texts = STRANGE + [t for _, t, _, _ in odd_documents() if t]
    mine = sentencepiece.Codec(open(PIECES, "rb").read()).encode_batch(texts)
    ref = spm.SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)
    assert [x.tolist() for x in mine] == ref


def test_viterbi_is_the_best_path():
    c = sentencepiece.Codec(open(PIECES, "rb").read(), "viterbi")
    m = c.model

    def best(word):
        score = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - m.longest), e):
                i = m.by_text.get(word[s:e])
                v = m.scores[i] if i is not None else (m.unknown_score if e - s == 1 else -np.inf)
                score[e] = max(score[e], score[s] + float(v))
        return score[-1]

    words = ["\u2581" + w for w in "hello unbelievable hend thstinnt zzzz a x-y \u6f22\u5b57 na\u00efve".split()]
    for w in words:
        mat = np.array([[ord(x) for x in w]], np.uint64)
        path, size = sentencepiece.viterbi(m, mat)
        total = sum(float(m.scores[p]) if p >= 0 else m.unknown_score for p in path[0, : size[0]].tolist())
        assert total == best(w)


def test_viterbi_round_trip():
    c = sentencepiece.Codec(open(PIECES, "rb").read(), "viterbi")
    texts = [x for x in STRANGE if "\u2581" not in x]
    ids = c.encode_batch(texts)
    for t, i in zip(texts, ids):
        assert c.decode(i) == t


def test_sentencepiece_frames(spark, odd, none):
    enc = sentencepiece.encode(odd, PIECES)
    back = {(r.doc_id, r.text) for r in sentencepiece.decode(enc, PIECES).collect()}
    assert back == {(d, t or "") for d, t, _, _ in odd_documents()}
    rows = sentencepiece.digest(odd, PIECES).collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(odd_documents())
    assert sentencepiece.digest(none, PIECES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_unit_cache_matches_the_library(path):
    texts = STRANGE + [t for _, t, _, _ in odd_documents() if t]
    tok, enc = Tokenizer.from_file(path), Encoder(path, limit=50)
    for _ in range(2):
        for t in texts:
            assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, t[:50]


def test_packing(spark, odd, none):
    tok = Tokenizer.from_file(BYTES)
    want = sorted((d if d is not None else -1, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for d, t, _, _ in odd_documents())
    rows = packing.pack(odd.coalesce(1), BYTES, window=64, block=512).collect()
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    sizes = {}
    for d, t, _, _ in odd_documents():
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        sizes[d, n] = sizes.get((d, n), 0) + 1
    assert {k: sum(r.length for r in v) for k, v in docs.items()} == {(d, n): n * c for (d, n), c in sizes.items()}
    assert len(want) == len(odd_documents())
    padding = 0
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and all(r.sequence_tokens == at for r in own)
        padding += own[0].padding
    assert padding < 0.05 * sum(sizes[k] * k[1] for k in sizes)
    whole = [r for r in rows if r.doc_id == 12]
    ids = np.array(tok.encode(odd_documents()[12][1], add_special_tokens=False).ids + [0], "<u4")
    for r in whole:
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(none, BYTES).count() == 0


def _waste(size, window):
    return 0 if size & (size - 1) == 0 else window - size


def _least(pen, window):
    f = [0]
    for j in range(1, len(pen)):
        f.append(min(f[i] + _waste(j - i, window) for i in range(max(0, j - window), j)) + int(pen[j]))
    return f[-1]


def _cost(at, pen, window):
    assert at[0] == 0 and all(0 < b - a <= window for a, b in zip(at, at[1:]))
    return sum(_waste(b - a, window) + int(pen[b]) for a, b in zip(at, at[1:]))


def test_cuts_are_optimal():
    rng = np.random.default_rng(5)
    for window, dear in ((4, 3), (8, 9), (8, 1), (16, 40), (64, 5), (64, 50), (128, 2)):
        for n in (1, 2, 7, 8, 9, 30, 61, 200, 515):
            for free in (0, 0.02, 0.3):
                pen = np.where(rng.random(n + 1) < free, 0, rng.integers(1, dear + 1, n + 1))
                pen[0] = pen[-1] = 0
                at = packing.cuts(pen, window, True).tolist()
                assert at[-1] == n
                assert _cost(at, pen, window) == _least(pen, window)
    n = 12_000  # the production window and penalties
    pen = rng.choice([6, 24, 48], n + 1, p=[0.05, 0.6, 0.35])
    pen[np.r_[0, np.cumsum(rng.integers(200, 900, 12)), n]] = 0
    assert _cost(packing.cuts(pen, 1024, True).tolist(), pen, 1024) == _least(pen, 1024)
    # many free cuts: small windows in any order
    pen = np.full(n + 1, 48)
    pen[np.cumsum(np.tile([2, 1, 256, 1], 46))] = pen[[0, n]] = 0
    assert _cost(packing.cuts(pen, 1024, True).tolist(), pen, 1024) == _least(pen, 1024)


def test_cuts_of_blocks_join():
    rng = np.random.default_rng(6)
    pen = np.where(rng.random(6001) < 0.01, 0, rng.integers(1, 6, 6001))
    pen[0] = pen[-1] = 0
    at, begin = [0], 0
    while begin < 6000:
        end = min(begin + 1500, 6000)
        own = pen[begin : end + 1].copy()
        own[0] = 0
        part = packing.cuts(own, 64, end == 6000)
        assert len(part) > 1 and (end == 6000 or part[-1] <= len(own) - 1 - 8 * 64)
        at += (part[1:] + begin).tolist()
        begin = at[-1]
    assert _cost(at, pen, 64) <= 1.01 * _least(pen, 64)


def test_bits_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 5, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
        assert (tokenfile.unpack_bits(tokenfile.pack_bits(ids, bits), bits, len(ids)) == ids).all()


def test_token_file_random_access(tmp_path):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 49_408, 30_000).astype("<u4")
    p = tmp_path / "x.bin"
    with open(p, "wb") as f:
        w = tokenfile.TokenFileWriter(f, 17)
        for k in range(0, len(ids), 777):
            assert w.add(ids[k : k + 777]) == k
        w.close()
    with open(p, "rb") as f:
        r = tokenfile.TokenFileReader(f)
        for a, n in ((0, 1), (4095, 2), (29_999, 1), (123, 20_000), (8192, 4096), (5, 0)):
            assert (r.read(a, n) == ids[a : a + n]).all()
        with pytest.raises(IndexError):
            r.read(29_999, 2)


def test_token_files(spark, odd, none, work):
    tok = Tokenizer.from_file(WORDS)
    rows = tokenfile.read_tokens(tokenfile.write_tokens(odd, work, WORDS, 2)).collect()
    want = sorted(((-1 if d is None else d), zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()), len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, _, _ in odd_documents())
    got = sorted(rows, key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got] == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, work + "-none", WORDS, 2)).count() == 0


def brute_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = {x for x in g if g.count(x) > 1} if len(g) < 2000 else {x for x, n in __import__("collections").Counter(g).items() if n > 1}
    covered = {k + j for k, x in enumerate(g) if x in many for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, none):
    got = {}
    for r in quality.apply_policy(quality.ledger(odd), quality.POLICIES["v2"]).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t, _, _ in odd_documents():
        r = got[d][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), d
        assert (r.failed_mask & 1 == 1) == (r.n_words < 50)
        assert r.kept == (r.failed_mask & quality.POLICIES["v2"].mask == 0)
    repeated = spark.createDataFrame([(1, "a b c a b c\nx\nx\n\n \n" * 3)], "doc_id long, text string")
    r = quality.ledger(repeated).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality("a b c a b c\nx\nx\n\n \n" * 3)
    assert quality.ledger(none).count() == 0


def test_quality_trims_blanks_only(spark):
    texts = ["f hello", "for a bf", "of a leaf of a leaf", "hello world\f", "\f one two\x0b\f", "f", "ff\fff", "\f", "fa b c x fa b c f", "\\f a \\u000b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id]), texts[r.doc_id]


def test_ablation(spark, odd):
    book = quality.ledger(odd)
    rows = {r.rule: r for r in quality.ablation(book, quality.POLICIES["v1"]).collect()}
    masks = [r.failed_mask & quality.POLICIES["v1"].mask for r in book.collect()]
    for k, (name, _) in enumerate(quality.RULES):
        if name in rows:
            assert rows[name].n_failed_rule == sum(bool(m >> k & 1) for m in masks)
            assert rows[name].n_failed_only == sum(m == 1 << k for m in masks)
            assert rows[name].n_failed == sum(m != 0 for m in masks)


def test_quality_is_native(spark, sf, capsys):
    quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
