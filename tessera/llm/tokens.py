"""Whole-text tokenisation with the tokenizers library, cached by unit.

Both supported pre-tokenisers (byte-level, and letters / digits / rest with white space
dropped) never join characters across the units below, so a text's ids are the ids of its
units one after another. A unit seen before costs a dictionary look-up. Texts that hold a
special token or unusual control characters go to the library whole, as do all texts of a
tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import numpy as np

WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\u180e\u200b\u2060\ufeff]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable ones stand for themselves, the rest for U+0100 onwards."""
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Cache(dict):
    """Units' ids; when full, it becomes the older generation, from which units in use are taken over."""

    def __init__(self, make, limit):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, unit):
        x = self.older.get(unit)
        x = self[unit] = self.make(unit) if x is None else x
        return x

    def turn(self):
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [a["content"] for a in spec.get("added_tokens") or []]
        self.special_ids = {a["id"] for a in spec.get("added_tokens") or []}
        self.vocab = max([*(spec["model"].get("vocab") or {"": 0}).values(), *(a["id"] for a in spec.get("added_tokens") or [])]) + 1
        pre, norm, kind = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), None
        if spec["model"].get("type") == "BPE" and not spec["model"].get("dropout"):
            if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
                kind = "byte"
            elif norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("behavior") == "Removed":
                kind = "word"
        self.kind, self.model = kind, self.tok.model
        self.table = byte_alphabet()
        self.spell = dict(enumerate(self.table))
        self.ranked = self._by_rank(spec["model"]) if kind else None
        lead = " ?" if kind == "byte" else ""
        self.units = re.compile(rf"{lead}[{LETTER}]+(?=[{WHITE}.,;:!?]|\Z)|{lead}[^{WHITE}]+" + (rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+" if kind == "byte" else ""))
        self.simple = re.compile(rf"{lead}[{LETTER}]+")
        self.cache = _Cache(self._unit, limit)

    def _by_rank(self, model: dict):
        """Where ids rise in the order of the merges, tiktoken gives the same ids for a word, faster; else None.

        A suffix that marks a word's end becomes the byte 0, which no plain word holds; its ids
        lie below those of all merges, so that it joins the last byte first.
        """
        import tiktoken

        suffix = model.get("end_of_word_suffix") or ""
        back, vocab = {c: b for b, c in enumerate(self.table)}, model["vocab"]
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        first = 512 if suffix else 256
        if None in made or made != sorted(made) or min(made, default=first) < first or any(vocab.get(c, first) >= 256 for c in self.table) or any(not 256 <= vocab.get(c + suffix, 0) < first for c in self.table if suffix):
            return None
        ranks = {}
        for piece, i in vocab.items():
            if i not in self.special_ids:
                ended = bool(suffix) and piece.endswith(suffix)
                own = bytes(map(back.__getitem__, piece.removesuffix(suffix) if ended else piece)) + b"\0" * ended
                if own in ranks:
                    return None
                ranks[own] = i
        fast = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return (lambda unit: fast(unit + "\0")) if suffix else fast

    def _unit(self, unit: str) -> bytes:
        if len(unit) < 64 and self.simple.fullmatch(unit):
            if self.kind == "word":
                unit = unicodedata.normalize("NFC", unit).lower()
            ids = self.ranked(unit) if self.ranked else [x.id for x in self.model.tokenize(unit.encode().decode("latin-1").translate(self.spell))]
        else:
            ids = self.tok.encode(unit, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as little-endian uint32; null counts as empty."""
        if not text:
            return np.zeros(0, "<u4")
        if self.kind is None or any(s in text for s in self.special) or ODD.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        self.cache.turn()
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.units.findall(text))), "<u4")


_ENCODERS: dict[tuple, Encoder] = {}


def drop_encoders() -> None:
    _ENCODERS.clear()


def encoder(path: str, limit: int = 300_000) -> Encoder:
    """One encoder per worker process, file and cache size (units a generation, about 200 bytes each)."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = Encoder(path, limit)
    return _ENCODERS[path, limit]
