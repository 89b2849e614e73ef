"""Byte-level BPE through the tokenizers library, which sees each distinct pre-token once.

The split pattern of byte-level vocabularies is followed with numpy over the code points of a
batch; pre-tokens are told apart by 64-bit hashes, and only new ones go to the library, whose ids
for them are kept for the batches that follow. Texts outside the range that the class table covers,
with contractions or with added tokens go to the library as a whole, as does everything for a
vocabulary with another pre-tokenizer, a normalizer or a post-processor.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import gather_runs, offsets
from .shingles import BACK, BASE, _power, mix

#: Code points whose classes all Unicode versions in use agree on.
COVERED = 0x250
LETTER, NUMBER, OTHER, BLANK, SPACE = 0, 1, 2, 3, 4
#: Pre-tokens that a worker keeps between batches.
KEPT = 400_000


def _classes() -> np.ndarray:
    """The class of each covered code point; 4 is the space that joins what follows."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(COVERED)], np.uint8)
    out[[9, 10, 11, 12, 13, 0x85, 0xA0]] = BLANK
    out[32] = SPACE
    return out


CLASS = _classes()
WEIGHT = mix(np.arange(COVERED, dtype=np.uint64) + np.uint64(12345)) | np.uint64(1)


class ByteBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_str(json.dumps(spec))
        pre = spec.get("pre_tokenizer") or {}
        self.split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor") and not spec.get("truncation")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        vocab = spec["model"]["vocab"]
        self.leads = np.zeros(max(vocab.values()) + 1 + len(self.added), bool)
        self.leads[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.length, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Words led by a space go to the library many in one text; each begins at a token led by one."""
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        led = len(plain)
        if led < len(new):
            new = plain + list(set(new).difference(plain))
        ids, counts = [], []
        for part in self._whole(["".join(new[i : min(i + 500, led)]) for i in range(0, led, 500)]):
            ids.append(part)
            counts.append(np.diff(np.append(np.flatnonzero(self.leads[part]), len(part))))
        for part in self._whole(new[led:]):
            ids.append(part)
            counts.append([len(part)])
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        if len(counts) != len(new):
            raise ValueError("the vocabulary splits words otherwise than its pattern says")
        n = len(self.known)
        while n + len(new) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[n : n + len(new)] = self.used + np.cumsum(counts) - counts
        self.length[n : n + len(new)] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the offsets of the texts in it; a null is empty."""
        off = offsets(text)
        data = text.buffers()[2] if len(text) else None
        raw = memoryview(data)[int(off[0]) : int(off[-1])] if data is not None else memoryview(b"")
        whole = str(raw, "utf-8")
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        heads = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
        off = heads[off - off[0]]
        odd = self._odd(points, off, whole)
        if odd.any():  # the library's own way for these, the fast one for the runs between them
            parts, lens = [], []
            edges = np.flatnonzero(np.append(True, odd[1:] != odd[:-1]))
            for i, j in zip(edges.tolist(), np.append(edges[1:], len(odd)).tolist(), strict=True):
                if odd[i]:
                    got = self._whole([whole[off[k] : off[k + 1]] for k in range(i, j)])
                    parts += got
                    lens.append([len(g) for g in got])
                else:
                    ids, o = self._split(points[off[i] : off[j]], off[i : j + 1] - off[i], whole[off[i] : off[j]])
                    parts.append(ids)
                    lens.append(np.diff(o))
            return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(lens).astype(np.int64)))
        return self._split(points, off, whole)

    def _odd(self, points: np.ndarray, off: np.ndarray, whole: str) -> np.ndarray:
        out = np.full(len(off) - 1, not self.split)
        at = [np.flatnonzero(points >= COVERED)]
        quote = np.flatnonzero(points[:-1] == 39)
        at.append(quote[np.isin(points[quote + 1], [ord(c) for c in "sdmtlvr"])])
        for token in self.added:
            i = whole.find(token)
            while i >= 0:
                at.append(np.array([i]))
                i = whole.find(token, i + len(token))
        at = np.concatenate(at)
        out[np.searchsorted(off, at, "right") - 1] = True
        return out

    def _split(self, points: np.ndarray, off: np.ndarray, whole: str) -> tuple[np.ndarray, np.ndarray]:
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        c = CLASS[points]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        blank = c >= BLANK
        prev = np.empty_like(c)
        prev[0], prev[1:] = OTHER, c[:-1]
        before = np.append(False, blank[:-1])
        followed = np.append(~blank[1:], False) & ~edge[1:]
        start = np.where(blank, ~before | followed, np.where(before, prev != SPACE, c != prev)) | edge[:-1]
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(WEIGHT[points] * _power(BASE, n), out=total[1:])
        h = mix((total[end] - total[begin]) * _power(BACK, n)[begin])
        _, one, index = np.unique(h, return_index=True, return_inverse=True)
        words = [whole[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
        fresh = set(words).difference(self.known)
        if fresh:
            self._learn(list(fresh))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[index]
        per = self.length[at]
        ids = self.flat[gather_runs(self.start[at], per)]
        out = np.append(0, np.cumsum(per))[np.searchsorted(begin, off)]
        if len(self.known) > KEPT or len(self.flat) > 16 * KEPT or len(max(fresh, key=len, default="")) > 1 << 16:
            self._forget()
        return ids, out


@functools.cache
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
