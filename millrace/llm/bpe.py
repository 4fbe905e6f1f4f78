"""A byte-level BPE encoder in numpy matrices (problem 7), and its Spark operators.

Texts of an Arrow batch are handled together, never one by one: code points are classified by a table, word starts come
from comparisons of neighbours, words are looked up by a hash and compared byte by byte with the word found there, and
only words not met before are merged. Those are grouped by length into padded matrices; each round every row merges its
leftmost pair of minimum rank, found by a hashed pair lookup, and closes the gap, until no row has a pair left. A word
too long for a matrix merges all places of its minimum rank in a round, in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie, unless the caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Bytes of a word up to which it is merged in a matrix.
LONGEST_ROW = 512
#: Words remembered per Python worker; when more are known, the memory starts afresh.
REMEMBERED = 1_000_000
#: Bytes of text handled at a time.
SLICE = 1_500_000

_NONE = np.int64(1 << 40)  # rank of a pair that doesn't merge
_WITHIN = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)  # masks of the first n of eight bytes
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


def _classes() -> np.ndarray:
    """Class of each code point under the splitting pattern: letter, number, white space or other."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    for name, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(name, text):
            table[points[m.start() : m.end()]] = kind
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``size`` of each, one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


class _Eights:
    """Words of a byte array, eight bytes at a time."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.view = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from any place on

    def part(self, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of each word, zero beyond its end."""
        return self.view[start + 8 * k] & _WITHIN[np.minimum(size - 8 * k, 8)]

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = _mix(self.part(start, size, 0) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        k, live = 1, np.flatnonzero(size > 8)
        while len(live) and k < LONGEST_ROW // 8:
            h[live] = _mix(h[live] ^ self.part(start[live], size[live], k))
            k, live = k + 1, live[size[live] > 8 * (k + 1)]
        for i in live:  # long words are few
            word = self.raw[start[i] : start[i] + size[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def equal(self, start: np.ndarray, other: _Eights, other_start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each word is, byte by byte, the word of the same size in ``other``."""
        same = self.part(start, size, 0) == other.part(other_start, size, 0)
        k, live = 1, np.flatnonzero(same & (size > 8))
        while len(live) and k < LONGEST_ROW // 8:
            ok = self.part(start[live], size[live], k) == other.part(other_start[live], size[live], k)
            same[live[~ok]] = False
            k, live = k + 1, live[ok & (size[live] > 8 * (k + 1))]
        for i in live:
            a, b, n = start[i], other_start[i], size[i]
            same[i] = np.array_equal(self.raw[a : a + n], other.raw[b : b + n])
        return same


class PairTable:
    """(left id, right id) to merged id, by open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        self.mask = np.int64((1 << (64 - int(self.bits))) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.vals = np.full(int(self.mask) + 1, _NONE)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # claim a free slot each; who loses the race moves on
            free = self.keys[at[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[todo[free]]] = keys[todo[free]]
            won = self.keys[at[todo]] == keys[todo]
            self.vals[at[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.full(len(keys), _NONE)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            same = held == keys[todo]
            out[todo[same]] = self.vals[at[same]]
            more = ~same & (held != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, at = todo[more], (at[more] + 1) & self.mask
        return out


class Encoder:
    """Ids of texts by a byte-level vocabulary whose rank file gives, per line, a token in base 64 and its id."""

    def __init__(self, rank_file: str):
        ranks: dict[bytes, int] = {}
        with open(rank_file, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        # A pair merges when its concatenation is a token; its rank is that token's id.
        triples = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*triples))
        self.pairs = PairTable(left, right, merged)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.whole = ranks
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.seen = np.empty(0, np.uint64)  # hashes of the known words, sorted; equal ones stand together
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)  # where the bytes of each word lie
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)  # where its ids lie
        self.bytes = np.empty(0, np.uint8)
        self.eights = _Eights(self.bytes)
        self.flat = np.empty(0, np.int32)

    def split(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte offsets at which words start in the UTF-8 bytes ``raw`` of texts that start at ``bounds`` (unique)."""
        if not len(raw):
            return np.empty(0, np.int64)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each code point
        if len(lead) == len(raw):
            points = raw.astype(np.uint32)
        else:
            points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        n = len(kind)
        begin = np.zeros(n + 1, bool)  # texts begin here, and one past the end
        begin[np.searchsorted(lead, bounds)] = True
        begin[n] = True
        space, blank = kind == _SPACE, points == 32
        start = begin[:n].copy()
        start[1:] |= (kind[1:] != kind[:-1]) & ~(blank[:-1] & ~begin[1:n])
        # Of a run of white space before a word, the last is on its own, or belongs to the word if it is a blank.
        last = space.copy()
        last[:-1] &= ~space[1:]
        last &= ~begin[1:]  # a run that ends its text is one word
        start |= last
        # 's 't 'm 'd 're 've 'll, where the apostrophe starts a word
        quote = np.flatnonzero(start & (points == 39))
        if len(quote):
            ahead = np.concatenate([points, np.zeros(2, np.uint32)])
            ends = np.concatenate([begin, np.ones(2, bool)])
            a, b = ahead[quote + 1], ahead[quote + 2]
            one = np.isin(a, [115, 116, 109, 100]) & ~ends[quote + 1]
            two = ~one & ~ends[quote + 1] & ~ends[quote + 2] & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
            for hit, width in ((quote[one], 2), (quote[two], 3)):
                start[hit + 1] = False
                after = hit + width
                start[after[after < n]] = True
        return lead[start]

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One word of any length. Places wait in a bucket per rank; the lowest bucket is merged from left to right at
        once, up to the first merge that creates a pair of a still lower rank."""
        n = len(ids)
        tok = np.append(ids, -1)  # token at each living place; the end mark pairs with nothing
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n, bool)
        rank = np.full(n + 1, _NONE)
        rank[: n - 1] = self.pairs.get(ids[:-1], ids[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def wait(places: np.ndarray) -> None:
            r = rank[places]
            o = np.argsort(r, kind="stable")
            o = o[: int(np.searchsorted(r[o], _NONE))]
            r, places = r[o], places[o]
            cut = np.flatnonzero(np.diff(r)) + 1
            for value, part in zip(r[np.append(0, cut)].tolist() if len(r) else (), np.split(places, cut)):
                if value not in waiting:
                    heapq.heappush(order, value)
                    waiting[value] = []
                waiting[value].append(part)

        def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            out = np.full(len(left), _NONE)
            real = (left >= 0) & (right >= 0)
            out[real] = self.pairs.get(left[real], right[real])
            return out

        wait(np.arange(n - 1))
        while order:
            r = heapq.heappop(order)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]  # others have changed or gone since
            if not len(at):
                continue
            # Of places that overlap one another (a run of equal tokens) every second one merges.
            chained = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
            head = np.flatnonzero(~chained)
            at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]
            after = nxt[nxt[at]]
            before = prv[at]
            touching = np.concatenate(([False], after[:-1] == at[1:]))  # the merge before this one ends where it begins
            left = np.where(touching, r, tok[before])
            left[before < 0] = -1
            lower = (pair(left, np.full(len(at), r)) < r) | (pair(np.full(len(at), r), tok[after]) < r)
            if lower.any():
                k = int(lower.argmax()) + 1
                waiting[r] = [at[k:]]
                heapq.heappush(order, r)
                at, after, before = at[:k], after[:k], before[:k]
            rank[nxt[at]] = _NONE
            alive[nxt[at]] = False
            tok[at] = r
            nxt[at] = after
            prv[after] = at
            left = prv[at]
            fresh = np.unique(np.concatenate([at, left[left >= 0]]))
            rank[fresh] = pair(tok[fresh], tok[nxt[fresh]])
            wait(fresh)
        return tok[:n][alive]

    def merge(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``rows`` of initial ids, padded; merged in place. Gives the rows and their new lengths."""
        n, width = rows.shape
        length = length.copy()
        if width < 2:
            return rows, length
        col = np.arange(width)
        rank = np.full((n, width), _NONE)
        i, j = np.nonzero(col[None, :-1] < length[:, None] - 1)
        rank[i, j] = self.pairs.get(rows[i, j], rows[i, j + 1])
        live = np.arange(n)  # rows that may still merge; the finished ones drop out
        tok, rk, ln = rows.copy(), rank, length.copy()
        while True:
            p = rk.argmin(1)  # the leftmost of the smallest
            r = np.arange(len(live))
            best = rk[r, p]
            go = best != _NONE
            if not go.all():
                done = live[~go]
                rows[done], length[done] = tok[~go], ln[~go]
                live, tok, rk, ln, p, best = live[go], tok[go], rk[go], ln[go], p[go], best[go]
                r = np.arange(len(live))
            if not len(live):
                return rows, length
            tok[r, p] = best
            # Close the gap at p + 1: every later column moves left by one.
            w = int(ln.max())
            shift = np.minimum(col[None, :w] + (col[None, :w] > p[:, None]), w - 1)
            tok = np.take_along_axis(tok[:, :w], shift, 1)
            rk = np.take_along_axis(rk[:, :w], np.minimum(col[None, :w] + (col[None, :w] > p[:, None]), w - 1), 1)
            ln = ln - 1
            full = tok.shape[1]
            if full < width:  # keep the stored width for writing back
                tok = np.pad(tok, ((0, 0), (0, width - full)))
                rk = np.pad(rk, ((0, 0), (0, width - full)), constant_values=_NONE)
            for q in (p - 1, p):
                ok = q >= 0
                qq = np.maximum(q, 0)
                has = ok & (qq + 1 < ln)
                rk[r[ok], qq[ok]] = _NONE
                rk[r[has], qq[has]] = self.pairs.get(tok[r[has], qq[has]], tok[r[has], qq[has] + 1])
            rk[r, ln - 1] = _NONE  # the last token has no pair

    def _learn(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given (distinct) words: counts, and all ids in order."""
        count = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word positions, lengths, padded ids
        singles: dict[int, np.ndarray] = {}
        low = 0
        for high in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, LONGEST_ROW):
            at = np.flatnonzero((size > low) & (size <= high))
            low = high
            step = max(1, 4_000_000 // (high * 8))
            for s in range(0, len(at), step):
                a = at[s : s + step]
                col = np.arange(high)
                inside = col[None, :] < size[a][:, None]
                pos = np.where(inside, start[a][:, None] + col, 0)
                ids = np.where(inside, self.byte_id[raw[pos]], -1)
                ids, n = self.merge(ids, size[a])
                count[a] = n
                parts.append((a, n, ids))
        for a in np.flatnonzero(size > LONGEST_ROW):
            singles[int(a)] = self._long(self.byte_id[raw[start[a] : start[a] + size[a]]])
            count[a] = len(singles[int(a)])
        off = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for a, n, ids in parts:
            i, j = np.nonzero(np.arange(ids.shape[1])[None, :] < n[:, None])
            flat[off[a][i] + j] = ids[i, j]
        for a, ids in singles.items():
            flat[off[a] : off[a] + len(ids)] = ids
        return count, flat

    def encode_bytes(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word starts of the texts, and for each word its place in the memory."""
        start = self.split(raw, bounds)
        size = np.diff(np.append(start, len(raw)))
        eights = _Eights(raw)
        h = eights.hashes(start, size)
        if len(self.seen) > REMEMBERED:
            self._forget()
        at = self._find(h, eights, start, size)
        new = np.flatnonzero(at < 0)
        while len(new):  # more than one round only where different new words share a hash
            order = new[np.argsort(h[new], kind="stable")]
            words = order[np.concatenate(([True], h[order][1:] != h[order][:-1]))]
            count, flat = self._learn(raw, start[words], size[words])
            place = np.searchsorted(self.seen, h[words])  # both sorted: the merge keeps the order
            ids_at, bytes_at = len(self.flat) + np.cumsum(count) - count, len(self.bytes) + np.cumsum(size[words]) - size[words]
            self.flat = np.concatenate([self.flat, flat])
            self.bytes = np.concatenate([self.bytes, raw[_ranges(start[words], size[words])]])
            self.eights = _Eights(self.bytes)
            self.at, self.size = np.insert(self.at, place, bytes_at), np.insert(self.size, place, size[words])
            self.start, self.count = np.insert(self.start, place, ids_at), np.insert(self.count, place, count)
            self.seen = np.insert(self.seen, place, h[words])
            known = np.flatnonzero(at >= 0)
            at[known] += np.searchsorted(place, at[known], "right")  # pushed back by the inserted ones
            at[new] = self._find(h[new], eights, start[new], size[new])
            new = new[at[new] < 0]
        return start, at

    def _find(self, h: np.ndarray, eights: _Eights, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of words, -1 where unknown. The hash only finds candidates: bytes decide."""
        out = np.full(len(h), -1)
        if not len(self.seen):
            return out
        keys, back = np.unique(h, return_inverse=True)  # sorted keys walk the memory in order
        at = np.searchsorted(self.seen, keys)[back]
        todo = np.arange(len(h))
        while len(todo):  # equal hashes stand together
            at_ = np.minimum(at[todo], len(self.seen) - 1)
            same = (at[todo] < len(self.seen)) & (self.seen[at_] == h[todo])
            todo, at_ = todo[same], at_[same]
            equal = self.size[at_] == size[todo]
            k = np.flatnonzero(equal)
            equal[k] = eights.equal(start[todo[k]], self.eights, self.at[at_[k]], size[todo[k]])
            out[todo[equal]] = at_[equal]
            todo = todo[~equal]
            at[todo] += 1
        return out

    def _texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Slices of a string column: first and past-the-last row, their bytes, their byte offsets."""
        if column.type != pa.large_string():
            column = column.cast(pa.large_string())
        column = column.fill_null("")
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        s = 0
        while s < len(column):
            e = max(s + 1, int(np.searchsorted(off, off[s] + SLICE, "right")) - 1)
            e = min(e, len(column))
            yield s, e, data[off[s] : off[e]], off[s : e + 1] - off[s]
            s = e

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Ids of each text; null and empty give an empty list."""
        lists = []
        for _, _, raw, off in self._texts(column):
            start, at = self.encode_bytes(raw, np.unique(off[:-1][off[1:] > off[:-1]]))
            n = self.count[at]
            total = np.concatenate(([0], np.cumsum(n)))
            ids = self.flat[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])]
            lists.append(pa.ListArray.from_arrays(pa.array(total[np.searchsorted(start, off)].astype(np.int32)), pa.array(ids)))
        return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = [np.empty(0, np.int64)]
        for _, _, raw, off in self._texts(column):
            start, at = self.encode_bytes(raw, np.unique(off[:-1][off[1:] > off[:-1]]))
            total = np.concatenate(([0], np.cumsum(self.count[at])))
            out.append(np.diff(total[np.searchsorted(start, off)]))
        return np.concatenate(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str, folder: str = TOKENIZERS) -> Encoder:
    """The encoder of this Python process for a vocabulary; built once."""
    path = os.path.join(folder, f"{tokenizer}.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_ids(docs: DataFrame, *, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, ids)``: each row's token ids without special tokens, in one pass without shuffle.

    One row out for each row in, repeated and null keys included. Null and empty texts give an empty list; strings that
    look like special tokens are ordinary text; texts of any length are encoded whole. Only the two columns are read.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.encode(part.column(1))], names=["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(docs: DataFrame, *, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, n_tokens)``: the length of what ``encode_ids`` gives, without the ids."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.lengths(b.column(1)))], names=["k", "n"])

    return rows.mapInArrow(run, f"k {kind}, n bigint").withColumnsRenamed({"k": key, "n": "n_tokens"})
