"""Packing of token streams into fixed windows by an order-preserving dynamic program.

Documents keep their order. A window holds at most `window` tokens. The cost of a cut list is the
padding of its windows (none where the length is a power of two) plus a penalty for each cut:
none after a document, small after a sentence, larger between words, largest inside a word.
  f(j) = penalty(j) + min(min over i in j - window .. j - 1 of f(i) + i + window - j,
                          min over powers of two s <= window of f(j - s))
The first, a sliding minimum, comes from a monotone queue in its two-stack form (suffix minima of
one half-window of positions, the minimum of the next), so that half a window of positions takes
a few vector operations; the second is relaxed over the half-window until nothing gets cheaper.
The stream is solved in blocks; a block's last windows are solved again with the next block, so
memory stays bounded and no padding arises between blocks. Within a block the cost is the least
of all. No shuffle: each scan task packs what it reads, and a lost task is packed again in the
same way.

Defined results: null or empty text gives the end id alone; a null doc_id is kept; repeated
rows are packed once each; very long texts run through as many windows as they need; of equally
cheap cuts the earliest counts, of equally cheap last windows the longest; other columns of the
input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import enter, ship
from .textops import slices
from .tokens import drop_encoders, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"


def penalties(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, starts_word: np.ndarray, costs: tuple[int, int, int]) -> np.ndarray:
    """Penalty of a cut before each position 0..len(ids)."""
    sentence, word, inside = costs
    out = np.full(len(ids) + 1, inside, np.int64)
    out[0] = 0
    if len(ids) > 1:
        out[1:-1][starts_word[ids[1:]]] = word
        out[1:-1][ends_sentence[ids[:-1]] & starts_word[ids[1:]]] = sentence
    out[doc_ends] = 0
    return out


def cuts(penalty: np.ndarray, window: int, last: bool, hold: int = 8) -> np.ndarray:
    """Cut positions (ascending, from 0) of the cheapest windows over len(penalty) - 1 tokens.

    last: the windows reach the end; else they stop `hold` windows before it, or half-way if that is less.
    """
    n, half = len(penalty) - 1, window // 2
    if n == 0:
        return np.zeros(1, np.int64)
    blocks = -(-(n + 1) // half)
    pen = np.zeros(blocks * half, np.int64)
    pen[: n + 1] = penalty
    f = np.full(window + blocks * half, np.int64(1) << 40)  # position p is f[window + p]
    f[window] = 0
    shifts = [1 << k for k in range(half.bit_length() - 2, -1, -1)]
    dear = int(penalty.max())
    # a padded window below half the size costs no less than powers of two of its length, unless cuts are very dear
    wide = any((size.bit_count() - 1) * dear > window - size for size in range(1, half))
    o = np.arange(half)
    older = before = f[:half].copy()  # suffix minima of f + place in the block, of the two blocks before
    least = int(f[0])  # the nearer one's minimum
    for b in range(blocks):
        lo = window + b * half
        own, p = f[lo : lo + half], pen[b * half : (b + 1) * half]
        best = np.minimum(older, least + half) - o
        np.minimum(best, f[lo - half : lo], out=best)
        best += p
        np.minimum(own, best, out=own)
        total = None
        while total != (total := int(own.sum())):  # windows within the block, until none is cheaper
            for s in shifts:
                np.minimum(own, f[lo - s : lo + half - s] + p, out=own)
            if wide:
                near = np.minimum.accumulate(own + o)[:-1] + window - o[1:] + p[1:]
                np.minimum(own[1:], near, out=own[1:])
        older, before = before, np.minimum.accumulate((own + o)[::-1])[::-1]
        least = int(before[0])
    size = np.arange(window, 0, -1)
    waste = np.where(size & (size - 1), window - size, 0)
    k = n if last else max(1, n - half) + int(np.argmin(f[window + max(1, n - half) : window + n + 1]))
    out = [k]
    while k > 0:
        k += int(np.argmin(f[k : k + window] + waste)) - window
        out.append(k)
    at = np.array(out[::-1], np.int64)
    return at if last else at[: np.searchsorted(at, n - min(hold * window, n // 2), "right")]


class Packer:
    """Takes documents in order; gives the pieces of finished windows."""

    def __init__(self, window, ends_sentence, starts_word, costs, sequence, block):
        self.window, self.flags, self.costs, self.sequence, self.block = window, (ends_sentence, starts_word), costs, sequence, block
        self.docs: list[tuple] = []  # (doc_id, start of what is left, ids left, doc_tokens)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool):
        if not self.docs:
            return
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        at = cuts(penalties(ids, ends, *self.flags, self.costs), self.window, last)
        done, k, begin = int(at[-1]), 0, 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            size = b - a
            pad = 0 if size & (size - 1) == 0 else self.window - size
            here = a
            while here < b:
                doc, start, own, total = self.docs[k]
                stop = min(b, int(ends[k]))
                piece = own[here - begin : stop - begin]
                yield doc, start + here - begin, stop - here, zlib.crc32(piece.tobytes()), total, self.sequence, here - a, size, pad
                here = stop
                if stop == ends[k]:
                    k, begin = k + 1, stop
            self.sequence += 1
        rest = self.docs[k:]
        if rest and done > begin:
            doc, start, own, total = rest[0]
            rest[0] = (doc, start + done - begin, own[done - begin :], total)
        self.docs, self.held = rest, len(ids) - done


def token_flags(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Per id: does it end a sentence; does it start a word (a space or line break before it)."""
    enc = encoder(path)
    ends, starts = np.zeros(enc.vocab, bool), np.zeros(enc.vocab, bool)
    space, newline = enc.table[32], enc.table[10]
    for piece, i in enc.tok.get_vocab().items():
        ends[i] = bool(re.search(r"[.!?]['\")\]]*\Z", piece)) or newline in piece
        starts[i] = piece[0] in (space, newline)
    return ends, starts


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, costs: tuple[int, int, int] = (6, 24, 48), block: int = 1 << 18) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `window` tokens (a power of two).

    costs: penalty, in tokens of padding, of a cut after a sentence, between words, inside a word.
    One row per piece, see SCHEMA; sequence_id holds the task's partition in its high bits.
    """
    if window & (window - 1) or window < 4:
        raise ValueError("window must be a power of two, 4 at least")
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        enter("tokens", drop_encoders)
        enc = encoder(tokenizer)
        packer = Packer(window, *token_flags(tokenizer), costs, TaskContext.get().partitionId() << 40, block)
        end = np.array([end_id], "<u4")
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def batch():
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in batches:
            ids, text = b.column("doc_id").to_pylist(), b.column("text")
            for lo, hi in slices(text):
                for doc, t in zip(ids[lo:hi], text.slice(lo, hi - lo).to_pylist()):
                    rows.extend(packer.add(doc, np.concatenate([enc.encode(t), end])))
                    if len(rows) > 20_000:
                        yield batch()
        rows.extend(packer.flush(True))
        if rows:
            yield batch()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
