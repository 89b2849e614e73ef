"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch are told apart by 64-bit hashes, and its distinct words lie in one flat numpy
array of symbols. Each round looks up the rank of every adjacent pair, takes the least rank of each word (a segmented
minimum), merges all leftmost non-overlapping pairs of that rank at once, and compacts the array;
a word without a pair that is in the vocabulary leaves. The result equals the library's, which
merges one pair at a time, as long as a merge makes no pair of the same or a better rank. For
the pieces that can, a word takes its leftmost pair of the round only, and a long one (runs of
spaces) goes through an agenda of single merges.

Nulls and empty texts have no pieces. Everything happens within a row: no shuffle, and any rows,
repeated or not, give the same result for the same text. Of the model types it takes BPE with
byte fallback and the identity normalizer, and raises ValueError for others.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat_bytes, gather_runs, pieces, trim
from .shingles import BACK, BASE, _power, mix

SPACE = "▁"
NONE = np.iinfo(np.int32).max
HASH = 0x9E3779B97F4A7C15
#: Symbols that go through the merge rounds together (but for a single longer word), and bytes encoded at once.
SYMBOLS, TEXT = 250_000, 1 << 20
#: Symbols over which a word that allows one merge a round only is left to the agenda.
AGENDA = 64


def _fields(raw: bytes) -> Iterable[tuple[int, int | bytes]]:
    """The (number, value) fields of one protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[i : i + n]
            i += n


class BpeModel:
    """Lookup tables of a model file, and encode and decode for lists of texts."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        rows = [dict(_fields(v)) for k, v in message if k == 1]
        trainer = dict(_fields(next(v for k, v in message if k == 2)))
        normalizer = dict(_fields(next(v for k, v in message if k == 3)))
        self.names = [r[1].decode() for r in rows]
        kinds = np.array([r.get(3, 1) for r in rows])
        scores = np.array([np.frombuffer(r.get(2, b"\0\0\0\0"), "<f4")[0] for r in rows])
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not set(kinds.tolist()) <= {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback and the identity normalizer, without user-defined pieces, are read")
        self.prefix = bool(normalizer.get(3, 1))
        self.eos = trainer.get(42, 2)
        self.unk = int(np.flatnonzero(kinds == 2)[0])
        unk_surface = trainer.get(44, " ⁇ ".encode())
        byte = {int(self.names[i][3:5], 16): int(i) for i in np.flatnonzero(kinds == 6)}
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int32)
        self._symbols(np.flatnonzero(kinds == 1).tolist(), scores)
        self._surfaces(kinds, unk_surface)

    def _symbols(self, normal: list[int], scores: np.ndarray) -> None:
        symbol = {self.names[i]: i for i in normal}
        pieces_of = dict(symbol)
        chars = sorted({c for p in pieces_of for c in p})
        self.extra = []
        for c in chars:
            if c not in symbol:
                symbol[c] = len(self.names) + len(self.extra)
                self.extra.append(ord(c))
        self.size = len(self.names) + len(self.extra) + 1
        self.other = self.size - 1  # any character that no piece has
        self.char = np.full(0x110000, self.other, np.int32)
        for c in chars:
            self.char[ord(c)] = symbol[c]
        rank = np.unique(-scores[normal], return_inverse=True)[1].astype(np.int32)
        rank_of = dict(zip(normal, rank.tolist(), strict=True))
        merges = {}
        unsafe = np.zeros(self.size, bool)
        for name, i in pieces_of.items():
            for k in range(1, len(name)):
                a, b = symbol.get(name[:k]), symbol.get(name[k:])
                if a is not None and b is not None:
                    merges[a * self.size + b] = (i, rank_of[i])
                    for part in (a, b):
                        if part in rank_of and len(self.names[part]) > 1 and rank_of[i] <= rank_of[part]:
                            unsafe[part] = True
        self.unsafe = unsafe
        self._table(merges)
        # No piece goes on behind a character that ends a word here.
        inner = {(a, b) for p in pieces_of for a, b in zip(p, p[1:], strict=False)}
        self.apart = [ord(c) for c in "\n\t\r" if not any(c in x for x in inner)]
        self.led = not any(b == SPACE and a != SPACE for a, b in inner)

    def _table(self, merges: dict[int, tuple[int, int]]) -> None:
        """An open hash table of the pairs, at most a quarter full; a lookup goes on to the next slot."""
        bits = max(8, (4 * len(merges)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 1, -1, np.int64)
        self.value = np.zeros((2, (1 << bits) + 1), np.int32)
        self.value[0] = NONE
        for key, (to, rank) in merges.items():
            slot = ((key * HASH) & (2**64 - 1)) >> int(self.shift)
            while self.keys[slot] >= 0:
                slot = (slot + 1) % (1 << bits)
            self.keys[slot] = key
            self.value[:, slot] = rank, to

    def _surfaces(self, kinds: np.ndarray, unk_surface: bytes) -> None:
        out = []
        for i, name in enumerate(self.names):
            out.append({3: b"", 2: unk_surface, 6: b""}.get(int(kinds[i])) if kinds[i] != 1 else name.replace(SPACE, " ").encode())
        for b, i in enumerate(self.byte_ids.tolist()):
            out[i] = bytes([b])
        self.is_byte = kinds == 6
        self.leads = np.array([kinds[i] == 1 and n.startswith(SPACE) for i, n in enumerate(self.names)])
        self.out_len = np.array([len(x) for x in out], np.int64)
        self.out_start = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.surface = out

    # encoding

    def _rank_pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        slot = ((key.astype(np.uint64) * np.uint64(HASH)) >> self.shift).astype(np.int64)
        have = self.keys[slot]
        on = np.flatnonzero((have != key) & (have >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) % (len(self.keys) - 1)
            have = self.keys[slot[on]]
            on = on[(have != key[on]) & (have >= 0)]
        slot[self.keys[slot] != key] = len(self.keys) - 1
        return self.value[0, slot], self.value[1, slot]

    def _merge(self, a: int, b: int) -> tuple[int, int] | None:
        """The rank of a pair and what it becomes."""
        key = a * self.size + b
        slot = ((key * HASH) & (2**64 - 1)) >> int(self.shift)
        while self.keys[slot] >= 0:
            if self.keys[slot] == key:
                return int(self.value[0, slot]), int(self.value[1, slot])
            slot = (slot + 1) % (len(self.keys) - 1)
        return None

    def _agenda(self, symbols: list[int]) -> list[int]:
        """Merge one pair at a time, best rank first and leftmost among equals."""
        sym = list(symbols)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def add(i: int, j: int) -> None:
            if i >= 0 and j < len(sym) and (m := self._merge(sym[i], sym[j])):
                heapq.heappush(heap, (m[0], i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            add(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j] = self._merge(a, b)[1], -1
            after[i] = after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            add(before[i], i)
            add(i, after[i])
        return [x for x in sym if x >= 0]

    def merge_words(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, whose code points lie one after another, in one array, and how many each word has."""
        sym, word = self.char[points], np.repeat(np.arange(len(lengths)), lengths)
        pos = np.arange(len(sym))  # where the symbol's first character is
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, to = np.zeros(len(sym), np.int32), np.zeros(len(sym), np.int32)
        fresh = np.arange(len(sym))  # symbols whose pair with the next one has no rank yet
        while len(sym):
            after = np.minimum(fresh + 1, len(sym) - 1)
            rank[fresh], to[fresh] = self._rank_pairs(sym[fresh], sym[after])
            rank[fresh[(word[after] != word[fresh]) | (after == fresh)]] = NONE
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = least != NONE
            pick = open_ & (rank == least)
            if not open_.all():
                end = ~open_
                done.append((sym[end], word[end], pos[end]))
            at = np.flatnonzero(pick)
            if len(at):  # of a run of overlapping pairs every second one, from its left end
                head = np.append(True, np.diff(at) != 1) | np.append(True, word[at[1:]] != word[at[:-1]])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
                owner = word[at]
                later = np.append(False, owner[1:] == owner[:-1])
                if later.any():  # several at once only where no merge makes a pair of this rank or a better one
                    risky = np.zeros(len(lengths), bool)
                    risky[owner[self.unsafe[to[at]]]] = True
                    single = np.zeros(len(lengths), bool)
                    single[owner[later]] = True
                    single &= risky
                    alone = single & (np.bincount(word, minlength=len(lengths)) > AGENDA)
                    if alone.any():
                        for w, i in zip(word[first].tolist(), range(len(first)), strict=True):
                            if alone[w]:
                                ids = np.array(self._agenda(sym[first[i] : first[i] + size[i]].tolist()), np.int32)
                                wide = np.array([len(self.names[x]) if x < len(self.names) else 1 for x in ids.tolist()])
                                done.append((ids, np.full(len(ids), w), pos[first[i]] + np.cumsum(wide) - wide))
                    at = at[~(later & single[owner])]
                    if alone.any():
                        at = at[~alone[word[at]]]
                        open_ &= ~alone[word]
                sym[at] = to[at]
                open_[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed = changed[open_]
            changed[:-1] |= changed[1:]
            fresh = np.flatnonzero(changed)
            sym, word, pos, rank, to = sym[open_], word[open_], pos[open_], rank[open_], to[open_]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        sym, word, pos = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(pos, kind="stable")
        sym, word, pos = sym[order], word[order], pos[order]
        raw = sym >= len(self.names)
        if not raw.any():
            return sym, np.bincount(word, minlength=len(lengths))
        cp = points[pos]  # characters without a piece become their UTF-8 bytes
        wide = np.where(raw, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
        out = np.repeat(sym, wide)
        text = np.frombuffer(cp[raw].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(raw, wide)] = self.byte_ids[text]
        return out.astype(np.int32), np.bincount(np.repeat(word, wide), minlength=len(lengths))

    def _points(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code points with spaces escaped and a prefix before each text that is not empty, and the texts' offsets."""
        raw, off = flat_bytes(text)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        off = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[off]
        if self.prefix:
            full = np.diff(off) > 0
            points = np.insert(points, off[:-1][full], ord(SPACE))
            off = off + np.append(0, np.cumsum(full))
        return np.where(points == 32, np.uint32(ord(SPACE)), points), off

    def encode(self, text: pa.Array, eos: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the texts in it; a null is empty."""
        points, off = self._points(text)
        n = len(points)
        start = np.zeros(n + 1, bool)
        start[off] = True  # no piece goes over these places
        if self.led:
            space = points == ord(SPACE)
            start[1:n] |= space[1:] & ~space[:-1]
        apart = np.isin(points, self.apart)
        start[:n] |= apart
        start[1:] |= apart
        begin = np.flatnonzero(start[:n])
        end = np.append(begin[1:], n)[: len(begin)]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points + np.uint64(HASH)) * _power(BASE, n), out=total[1:])
        h = mix((total[end] - total[begin]) * _power(BACK, n)[begin])
        _, one, index = np.unique(h, return_index=True, return_inverse=True)
        size = (end - begin)[one]
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        cut = np.cumsum(size)
        a = 0
        while a < len(one):
            b = max(a + 1, int(np.searchsorted(cut, (cut[a - 1] if a else 0) + SYMBOLS)))
            found = self.merge_words(points[gather_runs(begin[one[a:b]], size[a:b])], size[a:b])
            ids.append(found[0])
            counts.append(found[1])
            a = b
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        per = counts[index]
        ids = ids[gather_runs((np.cumsum(counts) - counts)[index], per)]
        ends = np.append(0, np.cumsum(per))[np.searchsorted(begin, off)]
        if eos:
            ids = np.insert(ids, ends[1:], self.eos)
            ends = ends + np.arange(len(ends))
        return ids, ends

    # decoding

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.names)):
            raise ValueError("an id is out of the vocabulary's range")
        lengths = self.out_len[ids]
        data = self.out[gather_runs(self.out_start[ids], lengths)]
        ends = np.append(0, np.cumsum(lengths))
        out = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            i, x = a, int(ends[a])
            while i < b and lengths[i] == 0:
                i += 1
            if self.prefix and i < b and self.leads[ids[i]]:
                x += 1
                if lengths[i] == 1 and i + 1 == b:
                    out.append("")
                    continue
            raw = data[x : ends[b]].tobytes()
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(self._decode_bytes(ids[a:b].tolist()))
        return out

    def _decode_bytes(self, ids: list[int]) -> str:
        """With ids of bytes that are no UTF-8: each such byte becomes U+FFFD."""
        out: list[str] = []
        run = b""

        def flush() -> None:
            nonlocal run
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    run = run[1:]

        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                flush()
                s = self.surface[i].decode()
                out.append(s[1:] if self.prefix and self.leads[i] and not any(out) else s)
        flush()
        return "".join(out)


@functools.cache
def load(path: str) -> BpeModel:
    return BpeModel(path)


def encode(text: Column, model_path: str, eos: bool = False) -> Column:
    """The ids of a text column, array<int>; of a null or empty text none (but for the end id)."""

    def run(x: pa.Array) -> pa.Array:
        model = load(model_path)
        parts = []
        for part in pieces(x, most=TEXT):
            ids, off = model.encode(part, eos)
            parts.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())))
        trim()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, model_path: str) -> Column:
    """The text of an array<int> column, as the library's decode(ids); of a null, a null."""

    def run(x: pa.Array) -> pa.Array:
        off = np.asarray(x.offsets).astype(np.int64)
        flat = np.asarray(x.values)[off[0] : off[-1]] if len(x) else np.zeros(0, np.int32)
        text = load(model_path).decode(flat, off - off[0])
        return pa.array(text, pa.string(), mask=np.asarray(x.is_null()))

    return F.arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): the ids of every whole text, with an end id, and their decoding."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col(key).alias(key), encode(F.col(text), model_path, eos=True).alias("ids"))
    return ids.select(key, "ids", decode(F.col("ids"), model_path).alias("decoded"))


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of op1 from encode_documents()."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
