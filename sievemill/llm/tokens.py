"""Token ids by the tokenizers library, with each distinct chunk of text encoded once.

A chunk is a part of the text that the tokenizer never joins with its neighbours, so the
ids of a text are those of its chunks in order. Where a chunk ends in a letter or digit and
then plain punctuation, those two are never joined either. Texts with the string of a token
that the file adds to its model (which the library gives that token's id), and all texts of
tokenizers whose chunks aren't known here, are encoded whole. ``tests/llm/test_tokens.py``
holds this against the library on whole texts.

``Encoder.batch`` finds the chunks of many texts at once in their bytes, and looks up
only the different ones, by a 64-bit hash.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from sievemill.llm import textbuf

#: White space of the tokenizers' regular expressions.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The splits of the two kinds of tokenizer whose chunks are known.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Their chunks, and whether letters are lower-cased.
KINDS = {
    "words": (re.compile("[^\\t-\\r ]+"), True),
    "bytes": (re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+"), False),
}
_TAIL, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True
_ALNUM[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_CONTROLS = "\x1c\x1d\x1e\x1f"
#: Most chunks that a process remembers.
CHUNKS = 800_000
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process: what it remembers serves the next task too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kind(spec: dict) -> str | None:
    """Which of ``KINDS`` a tokenizer file is of, by what it says."""
    normal, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or any(t["normalized"] for t in spec.get("added_tokens") or []):
        return None
    if normal is None and {k: pre.get(k) for k in _BYTES} == _BYTES and model.get("end_of_word_suffix") is None:
        return "bytes"
    steps = pre.get("pretokenizers") or [{}]
    parts = [s.get("type") for s in steps]
    split = steps[0].get("pattern") == {"Regex": _WORDS} and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    if parts == ["Split", "ByteLevel"] and split and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space"):
        if (normal or {}).get("normalizers") == _NORMAL and model.get("end_of_word_suffix") == "</w>":
            return "words"
    return None


def _without_tails(b: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple:
    """Chunks that end in an ASCII letter or digit and plain punctuation, in two."""
    if not len(start):
        return start, end, row
    z = end.copy()
    for _ in range(4):
        z -= _TAIL[b[z - 1]] & (z - 1 > start)
    cut = np.flatnonzero((z < end) & _ALNUM[b[z - 1]])
    begin, stop = np.concatenate([start, z[cut]]), np.concatenate([end, end[cut]])
    stop[cut] = z[cut]
    order = np.argsort(begin, kind="stable")
    return begin[order], stop[order], np.concatenate([row, row[cut]])[order]


def _lowered(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A-Z lower-cased in the chunks that are ASCII; others are left to the tokenizer."""
    if not len(start):
        return b
    wide = np.add.reduceat(np.append(b >= 0x80, False), np.stack([start, end], 1).ravel())[::2] > 0
    change = np.zeros(len(b) + 1, np.int32)
    change[start[wide]] += 1
    change[end[wide]] -= 1
    return np.where(np.cumsum(change[:-1]) > 0, b, textbuf._LOWER[b])


def _odd_space(texts: textbuf.Texts) -> np.ndarray:
    """Which rows have white space outside of ASCII."""
    b = texts.bytes
    if len(b) < 2:
        return np.zeros(texts.n, bool)
    two, third = (b[:-1].astype(np.uint16) << 8) | b[1:], np.append(b[2:], 0)
    hit = np.zeros(len(b), bool)
    hit[:-1] = (two == 0xC285) | (two == 0xC2A0) | ((two == 0xE19A) & (third == 0x80)) | ((two == 0xE280) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((two == 0xE281) & (third == 0x9F)) | ((two == 0xE380) & (third == 0x80))
    return textbuf.per_row(texts, hit) > 0


class Encoder:
    """``ids(texts)``: for each text its ids as little-endian unsigned 32-bit bytes.

    They are those that the library gives with ``add_special_tokens=False``. Null counts as
    empty.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = kind(spec)
        self.chunks, self.lower = KINDS.get(self.kind, (None, False))
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        # of an id: does a word end with it, or begin (with a space) with it?
        words = self.tokenizer.get_vocab()
        self.largest = max(words.values(), default=0)
        self.edge = np.zeros(self.largest + 1, bool)
        self.edge[[i for w, i in words.items() if (w.endswith("</w>") if self.lower else w.startswith("\u0120"))]] = True
        self.known: dict[str, bytes] = {}
        self.hashed: dict[int, bytes] = {}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        whole = [k for k, t in enumerate(texts) if self.kind is None or any(a in t for a in self.added)]
        split = [self._split(t) for t in texts] if self.kind else [[] for _ in texts]
        for k in whole:
            split[k] = []
        if len(self.known) > CHUNKS:
            self.known.clear()
        known = self.known
        new = list({c for chunks in split for c in chunks if c not in known})
        known.update(zip(new, self._encode(new), strict=True))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for lo in range(0, len(whole), 64):
            some = whole[lo : lo + 64]
            got = self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)
            for k, e in zip(some, got, strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def batch(self, texts: textbuf.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin, one more than rows)."""
        odd = self._odd(texts)
        start, end, row = self._units(texts)
        if len(odd):  # those texts as a whole
            keep = ~np.isin(row, odd)
            start, end, row = start[keep], end[keep], row[keep]
        start, end, row = _without_tails(texts.bytes, start, end, row)
        b = _lowered(texts.bytes, start, end) if self.lower else texts.bytes
        h, at, inverse = np.unique(textbuf.segment_hashes(b, start, end), return_index=True, return_inverse=True)
        if len(self.hashed) > CHUNKS:
            self.hashed.clear()
        keys = h.tolist()
        values = list(map(self.hashed.get, keys))
        missing = [k for k, v in enumerate(values) if v is None]
        data = b.tobytes()
        at = at[missing]
        new = [data[a:z].decode() for a, z in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        for k, v in zip(missing, self._encode(new), strict=True):
            self.hashed[keys[k]] = values[k] = v
        data = texts.bytes.tobytes() if len(odd) else data
        bounds = zip(texts.offsets[odd].tolist(), texts.offsets[odd + 1].tolist(), strict=True)
        values += self.ids([data[a:z].decode() for a, z in bounds])
        if len(odd):
            inverse, row = np.concatenate([inverse, len(h) + np.arange(len(odd))]), np.concatenate([row, odd])
            order = np.argsort(row, kind="stable")
            inverse, row = inverse[order], row[order]
        size = np.array([len(v) for v in values], np.int64) // 4
        blob = np.frombuffer(b"".join(values), "<u4")
        each = size[inverse]
        begin = np.cumsum(size) - size
        out = np.cumsum(each) - each
        index = np.repeat(begin[inverse] - out, each) + np.arange(int(each.sum()))
        counts = np.bincount(row, each, minlength=texts.n).astype(np.int64)
        return blob[index], np.concatenate([[0], np.cumsum(counts)])

    def _odd(self, texts: textbuf.Texts) -> np.ndarray:
        """Rows that aren't cut into chunks here: with white space of other kinds or the
        string of an added token, or all."""
        if self.kind is None:
            return np.flatnonzero(np.diff(texts.offsets))
        odd, data = _odd_space(texts), texts.bytes.tobytes()
        for key in (a.encode() for a in self.added):
            if self.lower:  # chunks are lower-cased before the library sees them
                key, data = key.lower(), data.lower()
            at = data.find(key)
            while at >= 0:
                odd[np.searchsorted(texts.offsets, at, "right") - 1] = True
                at = data.find(key, at + 1)
        return np.flatnonzero(odd)

    def _units(self, texts: textbuf.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = textbuf.Words(texts)
        start, end, row = words.start, words.end, words.row
        if self.lower:
            return start, end, row
        # a word takes one space before it; white space before that is a chunk, and so is
        # a last character that is no space
        gap = np.zeros(len(start), np.int64)
        gap[1:] = end[:-1]
        gap = np.maximum(gap, texts.offsets[row]) if len(row) else gap
        some = start > gap
        takes = some & (texts.bytes[np.maximum(start - 1, 0)] == 0x20) if len(start) else some
        before = start - 1 > gap
        single = some & ~takes
        last = np.maximum(texts.offsets[:-1], np.concatenate([[0], end])[words.first[1:]])
        tail = texts.offsets[1:] > last
        starts = np.concatenate([gap[before], start[single] - 1, start - takes, last[tail]])
        ends = np.concatenate([start[before] - 1, start[single], end, texts.offsets[1:][tail]])
        rows = np.concatenate([row[before], row[single], row, np.flatnonzero(tail)])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], rows[order]

    def _split(self, text: str) -> list[str]:
        # str.split() knows the same white space but for four control characters
        if self.lower and not any(c in text for c in _CONTROLS):
            return text.split()
        return self.chunks.findall(text)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Many words at once, as one text, where the ids tell them apart."""
        if self.lower:
            plain = [k for k, c in enumerate(chunks) if c.isalpha()]
        else:
            plain = [k for k, c in enumerate(chunks) if len(c) > 1 and c[0] == " " and c[1] != " "]
        out: list[bytes | None] = [None] * len(chunks)
        joined = [plain[lo : lo + 128] for lo in range(0, len(plain), 128)]
        texts = [(" " if self.lower else "").join([chunks[k] for k in some]) for some in joined]
        for some, e in zip(joined, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.edge[ids]).tolist()
            cuts = [0, *(c + 1 for c in cuts)] if self.lower else [*cuts, len(ids)]
            # one such id a word; else the words are encoded one by one
            if len(cuts) == len(some) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                data = ids.tobytes()
                for k, a, z in zip(some, cuts, cuts[1:], strict=False):
                    out[k] = data[4 * a : 4 * z]
        todo = [k for k, v in enumerate(out) if v is None]
        for lo in range(0, len(todo), 2048):
            some = todo[lo : lo + 2048]
            got = self.tokenizer.encode_batch_fast([chunks[k] for k in some], add_special_tokens=False)
            for k, e in zip(some, got, strict=True):
                out[k] = b"".join([i.to_bytes(4, "little") for i in e.ids])
        return out
