"""SentencePiece encoding and decoding in numpy, from a model file's pieces and scores.

White space becomes the mark U+2581 and a text is cut where no piece holds the two characters
side by side (before a run of marks, and between a letter and most signs), so these words are segmented independently, each distinct word once. Words of equal length advance together: at each end position
the hashes of all substrings that end there are looked up in the sorted hashes of the
pieces, and the best of (score of the prefix + score of the piece) and its start are stored
as back-pointers. Characters outside the vocabulary become byte pieces (or the unknown id).

A model of type UNIGRAM asks for the path of the highest total score, which this Viterbi
search finds (method "viterbi"). A model of type BPE defines its segmentation by merges in
order of score, which is not the best path; for it the same tables drive batched merging
(method "bpe"): in words of equal length the adjacent pair whose merged piece has the
highest score is found by looking up pair hashes, and is merged in all words at once.
"auto" follows the model's type, and so gives the ids of the reference library.

Only the normalisation rules "identity" are supported (others raise); a leading mark and the
collapsing of spaces follow the model's flags.

Defined results: null text counts as empty and has no ids; repeated rows are encoded alike;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import enter, ship
from .textops import U, mix, slices
from .tokens import LETTER

MARK = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
UNIGRAM, BPE = 1, 2
LONG = 48  # longer words are handled one by one


def _fields(data: bytes):
    """(field number, value) pairs of a protobuf message."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


class Model:
    """Pieces, scores, types and the flags of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces, scores, types = [], [], []
        self.kind, self.byte_fallback, self.prefix, self.squeeze, self.escape = UNIGRAM, False, True, True, True
        rules = b""
        for field, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode("utf-8")
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                types.append(kind)
            elif field == 2:
                for f, v in _fields(value):
                    if f == 3:
                        self.kind = v
                    elif f == 35:
                        self.byte_fallback = bool(v)
            elif field == 3:
                for f, v in _fields(value):
                    if f == 2:
                        rules = v
                    elif f == 3:
                        self.prefix = bool(v)
                    elif f == 4:
                        self.squeeze = bool(v)
                    elif f == 5:
                        self.escape = bool(v)
        if rules:
            raise ValueError("only identity normalisation is supported")
        self.scores, self.types = np.array(scores, np.float32), np.array(types)
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.bytes = {int(p[1:-1], 16): k for k, p in enumerate(self.pieces) if self.types[k] == BYTE}
        usable = np.flatnonzero((self.types == NORMAL) | (self.types == USER))
        codes = [np.array([ord(c) for c in self.pieces[k]], U) for k in usable]
        h = np.array([hash_codes(c[None, :])[0] for c in codes], U)
        order = np.argsort(h)
        self.hash, self.id = h[order], usable[order].astype(np.int64)
        self.longest = max(len(c) for c in codes)
        self.by_text = {self.pieces[k]: int(k) for k in usable}
        # an unknown character scores below every piece, as the reference library has it
        self.unknown_score = float(self.scores[usable].min()) - 10.0
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 where there is none."""
        out = np.full(h.shape, -1, np.int64)
        at = np.nonzero(self.seen[(h >> U(44)).astype(np.int64)])
        p = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        out[at] = np.where(self.hash[p] == h[at], self.id[p], -1)
        return out


_B = U(0x9E3779B97F4A7C15)


def hash_codes(m: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.zeros(len(m), U)
    for k in range(m.shape[1]):
        h = h * _B + m[:, k] + U(1)
    return mix(h)


def viterbi(model: Model, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of words of one length (rows of code points).

    Returns (paths, sizes): row r's first sizes[r] entries are piece ids, or -1 - position for
    a character without a piece.
    """
    n, size = m.shape
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0
    start = np.zeros((size + 1, n), np.int64)
    piece = np.full((size + 1, n), -1, np.int64)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(model.longest, _B)]))
    cols = np.ascontiguousarray(m.T) + U(1)
    row = np.arange(n)
    for end in range(1, size + 1):
        low = max(0, end - model.longest)
        h = np.zeros((end - low, n), U)  # raw hash of the substring from low + k to end
        h[-1] = cols[end - 1]
        for k in range(end - low - 2, -1, -1):
            h[k] = h[k + 1] + cols[low + k] * power[end - 1 - low - k]
        ids = model.find(mix(h))
        score = np.where(ids >= 0, model.scores[ids], -np.inf)
        score[-1, ids[-1] < 0] = model.unknown_score
        total = best[low:end] + score
        k = total.argmax(0)  # of equal totals the longest piece
        best[end], start[end], piece[end] = total[k, row], k + low, ids[k, row]
    # follow the back-pointers of all words together
    back = np.zeros((n, size), np.int64)
    sizes, at, live = np.zeros(n, np.int64), np.full(n, size), row
    while len(live):
        e = at[live]
        p, s = piece[e, live], start[e, live]
        back[live, sizes[live]] = np.where(p >= 0, p, -1 - s)
        sizes[live] += 1
        at[live] = s
        live = live[s > 0]
    turn = np.clip(sizes[:, None] - 1 - np.arange(size)[None, :], 0, None)
    return np.take_along_axis(back, turn, 1), sizes


def merge(model: Model, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BPE segmentations of words of one length, in the form of `viterbi`.

    Each step merges, in every word that still can, its pair of the highest score (of equal
    ones the leftmost); only the two pairs beside the merged one are looked up anew.
    """
    n, size = m.shape
    power = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size, _B)]))

    def scores(left, right, right_size):
        ids = model.find(mix(left * power[right_size] + right))
        return np.where(ids >= 0, model.scores[ids], -np.inf)

    h, length = m + U(1), np.ones((n, size), np.int64)
    count = np.full(n, size)
    out = np.zeros((n, size), np.int64)
    pair = np.full((n, size), -np.inf)  # score of merging a symbol with the next
    if size > 1:
        pair[:, :-1] = scores(h[:, :-1], h[:, 1:], length[:, 1:])
    live = np.arange(n)

    def finish(rows, h, length, count):
        ids = model.find(mix(h))
        begin = np.cumsum(length, 1) - length
        out[rows, : h.shape[1]] = np.where(ids >= 0, ids, -1 - begin)

    while len(live):
        k = pair.argmax(1)
        can = pair[np.arange(len(live)), k] > -np.inf
        if not can.all():
            end = ~can
            finish(live[end], h[end], length[end], count[live[end]])
            live, h, length, pair, k = live[can], h[can], length[can], pair[can], k[can]
            if not len(live):
                break
        row = np.arange(len(live))
        h[row, k] = h[row, k] * power[length[row, k + 1]] + h[row, k + 1]
        length[row, k] += length[row, k + 1]
        width = h.shape[1]
        at = np.arange(width - 1)[None, :]
        source = at + (at > k[:, None])
        h, length, pair = np.take_along_axis(h, source, 1), np.take_along_axis(length, source, 1), np.take_along_axis(pair, source, 1)
        count[live] -= 1
        left = np.flatnonzero(k > 0)
        pair[left, k[left] - 1] = scores(h[left, k[left] - 1], h[left, k[left]], length[left, k[left]])
        pair[row, k] = -np.inf
        right = np.flatnonzero(k + 1 < width - 1)
        pair[right, k[right]] = scores(h[right, k[right]], h[right, k[right] + 1], length[right, k[right] + 1])
    return out, count


def merge_long(model: Model, word: str) -> list[int]:
    """BPE of one long word with a heap."""
    import heapq

    n = len(word)
    nxt, prev, stop, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple] = []

    def push(a):
        b = nxt[a]
        if b < n:
            i = model.by_text.get(word[a : stop[b]])
            if i is not None:
                heapq.heappush(heap, (-float(model.scores[i]), a, stop[a], stop[b]))

    for a in range(n):
        push(a)
    while heap:
        _, a, middle, end = heapq.heappop(heap)
        if not alive[a] or stop[a] != middle:
            continue
        b = nxt[a]
        if b >= n or stop[b] != end:
            continue
        alive[b], stop[a], nxt[a] = False, end, nxt[b]
        if nxt[b] < n:
            prev[nxt[b]] = a
        push(a)
        if prev[a] >= 0:
            push(prev[a])
    out, a = [], 0
    while a < n:
        i = model.by_text.get(word[a : stop[a]])
        out.append(i if i is not None else -1 - a)
        a = nxt[a]
    return out


class _Lexicon:
    """Known words and, per method, their ids in one growing array."""

    def __init__(self, methods: int):
        self.at: dict[str, int] = {}
        self.flat = [np.zeros(1 << 16, "<u4") for _ in range(methods)]
        self.ends = [np.zeros(1 << 14, np.int64) for _ in range(methods)]  # end of word k's ids at k + 1

    def add(self, words: list[str], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        """Append words; ids and sizes per method, the words' ids one after another."""
        n = len(self.at)
        for k, (x, size) in enumerate(zip(ids, sizes)):
            begin = int(self.ends[k][n])
            while n + len(words) + 1 > len(self.ends[k]):
                self.ends[k] = np.concatenate([self.ends[k], np.zeros_like(self.ends[k])])
            while begin + len(x) > len(self.flat[k]):
                self.flat[k] = np.concatenate([self.flat[k], np.zeros_like(self.flat[k])])
            self.flat[k][begin : begin + len(x)] = x
            self.ends[k][n + 1 : n + 1 + len(words)] = begin + np.cumsum(size)
        self.at.update(zip(words, range(n, n + len(words))))

    def gather(self, index: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, number of ids per word) under method k."""
        begin = self.ends[k][index]
        size = self.ends[k][index + 1] - begin
        stop = np.cumsum(size)
        at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin - (stop - size), size)
        return self.flat[k][at], size


class Codec:
    """Encoder and decoder of a model file for one or more methods ("auto", "bpe", "viterbi")."""

    def __init__(self, data: bytes, *methods: str, limit: int = 400_000):
        m = self.model = Model(data)
        own = "bpe" if m.kind == BPE else "viterbi"
        self.methods = [own if x == "auto" else x for x in methods or ("auto",)]
        self.limit, self.now, self.older = limit, _Lexicon(len(self.methods)), _Lexicon(len(self.methods))
        # Text is cut where no piece holds the two characters side by side: before a run of
        # marks, and between a letter and a sign that follows no letter inside a piece.
        letter = re.compile(f"[{LETTER}]")
        signs, whole = set(".,!?;:\n*$%&#()\"'-"), True
        for p in m.by_text:
            for x, y in zip(p, p[1:]):
                whole &= y != MARK or x == MARK
                if y in signs and letter.match(x):
                    signs.discard(y)
        if not whole:
            raise ValueError("pieces with a mark after another character are not supported")
        after = "".join(re.escape(x) for x in sorted(signs))
        self.words = re.compile(f"{MARK}*[{LETTER}]+(?=[{after}{MARK}]|\\Z)|{MARK}+[^{MARK}]*|[^{MARK}]+")
        back = {k: b for b, k in m.bytes.items()}
        self.spelled = [bytes([back[k]]) if k in back else b"" if m.types[k] == CONTROL else " \u2047 ".encode() if k == m.unknown else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for k, p in enumerate(m.pieces)]

    def normalise(self, text: str) -> str:
        m = self.model
        if m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if m.prefix:
            text = " " + text
        return text.replace(" ", MARK) if m.escape else text

    def _ids(self, word: str, path: list[int]) -> list[int]:
        out, unknown = [], False
        for p in path:
            if p >= 0:
                out.append(p)
                unknown = False
            elif self.model.byte_fallback:
                out += [self.model.bytes[b] for b in word[-1 - p].encode("utf-8", "surrogatepass")]
            elif not unknown:  # neighbouring unknown characters are one unknown id
                out.append(self.model.unknown)
                unknown = True
        return out

    def _segment(self, words: list[str], matrix: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids per word) of words of one length."""
        size = matrix.shape[1]
        if method == "bpe" and size > LONG:
            own = [self._ids(w, merge_long(self.model, w)) for w in words]
            return np.array([i for x in own for i in x], "<u4"), np.array([len(x) for x in own])
        paths, sizes = (viterbi if method == "viterbi" else merge)(self.model, matrix)
        inside = np.arange(size)[None, :] < sizes[:, None]
        odd = np.flatnonzero(((paths < 0) & inside).any(1))
        if not len(odd):
            return paths[inside].astype("<u4"), sizes
        own = [self._ids(words[r], paths[r, : sizes[r]].tolist()) for r in odd]
        plain = np.ones(len(words), bool)
        plain[odd] = False
        total = sizes.copy()
        total[odd] = [len(x) for x in own]
        flat, ends = np.zeros(int(total.sum()), "<u4"), np.cumsum(total)
        flat[np.repeat(plain, total)] = paths[inside & plain[:, None]]
        for r, x in zip(odd, own):
            flat[ends[r] - len(x) : ends[r]] = x
        return flat, total

    def _learn(self, words: list[str]) -> None:
        """Segment new words, those of one length together."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for size, own in by.items():
            step = max(1, 400_000 // size)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                m = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size).astype(U)
                self.now.add(part, *zip(*[self._segment(part, m, x) for x in self.methods]))

    def index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lexicon place of every word of the normalised texts, words per text)."""
        if len(self.now.at) > self.limit:
            self.now, self.older = _Lexicon(len(self.methods)), self.now
        split = [self.words.findall(t) for t in texts]
        counts = np.array([len(x) for x in split], np.int64)
        flat = list(itertools.chain.from_iterable(split))
        new = set(flat).difference(self.now.at)
        if not new:
            return np.fromiter(map(self.now.at.__getitem__, flat), np.int64, len(flat)), counts
        again = [w for w in new if w in self.older.at]
        if again:
            at = np.fromiter(map(self.older.at.__getitem__, again), np.int64, len(again))
            self.now.add(again, *zip(*[self.older.gather(at, k) for k in range(len(self.methods))]))
            new.difference_update(again)
        self._learn(list(new))
        return np.fromiter(map(self.now.at.__getitem__, flat), np.int64, len(flat)), counts

    def encode_all(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """Per method, the ids of every text."""
        index, counts = self.index([self.normalise(t) if t else "" for t in texts])
        out = []
        ends = np.cumsum(counts)
        for k in range(len(self.methods)):
            ids, size = self.now.gather(index, k)
            at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
            out.append([ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.encode_all(texts)[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of ids: byte pieces stand for themselves, marks are spaces, the leading space goes."""
        data = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return data[1:] if self.model.prefix and data[:1] == b" " else data

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[tuple, Codec] = {}


def drop_codecs() -> None:
    _CODECS.clear()


def codec(path: str, *methods: str) -> Codec:
    """One codec per worker process, file and methods."""
    if (path, methods) not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path, methods] = Codec(f.read(), *methods)
    return _CODECS[path, methods]


def encode(docs: DataFrame, path: str, method: str = "auto") -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    ship(docs.sparkSession)

    def run(batches):
        c = codec(path, method)
        for b in batches:
            text = b.column("text")
            for lo, hi in slices(text, 1 << 20):
                ids = c.encode_batch(text.slice(lo, hi - lo).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    ship(encoded.sparkSession)

    def run(batches):
        c = codec(path)
        for b in batches:
            out = [c.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_crc32 long, viterbi_tokens long, viterbi_crc32 long, text_bytes long, round_trip boolean"


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: its ids by the model's own type, the Viterbi path's, and whether both decode to the text."""
    ship(docs.sparkSession)

    def run(batches):
        enter("sentencepiece", drop_codecs)
        c = codec(path, "auto", "viterbi")
        for b in batches:
            text = b.column("text")
            for lo, hi in slices(text, 1 << 20):
                texts = text.slice(lo, hi - lo).to_pylist()
                own, best = c.encode_all(texts)
                want = [((t if not c.model.squeeze else c.normalise(t).replace(MARK, " ").lstrip(" ")) if t else "").replace(MARK, " ").encode("utf-8", "surrogatepass") for t in texts]
                cols = [[len(x) for x in own], [zlib.crc32(x.tobytes()) for x in own], [len(x) for x in best], [zlib.crc32(x.tobytes()) for x in best], [len(w) for w in want]]
                ok = [c.decode_bytes(x) == w == c.decode_bytes(y) for x, y, w in zip(own, best, want)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *[pa.array(x, pa.int64()) for x in cols], pa.array(ok, pa.bool_())], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, DIGEST)
