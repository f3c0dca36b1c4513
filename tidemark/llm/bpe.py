"""Byte-level BPE over whole texts.

Each match of the split pattern is a small byte string. The distinct strings of a batch are
bucketed by length into padded numpy matrices (one row per string). In every round each row
merges its leftmost pair of minimum rank: all neighbouring pairs are looked up at once in an
open-addressing hash table of pairs, the row-wise first minimum is merged, and the row is
compacted to the left. Rows with no mergeable pair leave the matrix. A row costs the square of its
length there, so strings of more than ``LONG`` bytes, which prose does not have, keep their pairs in
a heap by (rank, place) instead: the same merges in the same order, in n log n. Decoding joins the byte
strings of the ids. The vocabulary (a fixed number of entries, checked) is read by the driver
from a path that is a parameter, and broadcast.

Defined results: a null text counts as empty; an empty text has no ids and the digests of the
empty string; every row is kept, repeated ids too; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The driver refuses to broadcast a larger vocabulary.
MAX_VOCABULARY = 1_000_000
#: Strings remembered by a worker between batches; a memory bound, not a limit on the text.
CACHE_STRINGS = 400_000
NONE = np.int64(1) << 40
#: Bytes of a string from which its pairs are kept in a heap.
LONG = 2048


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens")
    return ranks


class PairTable:
    """Hash table (left id, right id) -> merged id with linear probing, looked up in bulk."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.slots[at[todo]] < 0
            spots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.slots[spots], self.values[spots] = keys[put], values[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + (self.slots[at[todo]] >= 0)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where a pair doesn't merge or an end is padding."""
        out = np.full(left.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[todo] << 32 | right.ravel()[todo]
        at = self._home(keys)
        while len(todo):
            there = self.slots[at]
            hit = there == keys
            out.ravel()[todo[hit]] = self.values[at[hit]]
            go = ~hit & (there >= 0)
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & self.mask
        return out


class _Merges:
    """One pair at a time from a pair table."""

    def __init__(self, pairs: PairTable):
        self.pairs = pairs

    def get(self, key: int) -> int | None:
        p = self.pairs
        at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> int(p.shift)
        while (there := int(p.slots[at])) >= 0:
            if there == key:
                return int(p.values[at])
            at = (at + 1) & int(p.mask)
        return None


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = PairTable(ranks)
        self.merges = _Merges(self.pairs)
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each byte string."""
        out: list[list[int]] = [[] for _ in pieces]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = [self.ranks[p]]
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            elif p:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)  # matrix cells at a time
            for s in range(0, len(members), step):
                self._merge_bucket(pieces, members[s : s + step], width, out)
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """Leftmost pair of minimum rank first, by a heap over a linked list of the ids."""
        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])
        at = np.flatnonzero(ranks < NONE)
        heap = (ranks[at] * n + at).tolist()  # rank first, then place
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        pair: dict[int, int] = dict(zip(at.tolist(), ranks[at].tolist(), strict=True))  # place: rank of the pair that starts there

        def renew(i: int) -> None:
            pair.pop(i, None)
            if i >= 0 and after[i] >= 0:
                rank = self.merges.get(ids[i] << 32 | ids[after[i]])
                if rank is not None:
                    pair[i] = rank
                    heapq.heappush(heap, rank * n + i)

        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            if pair.get(i) != rank:  # merged or changed since
                continue
            j = after[i]
            ids[i], after[i] = rank, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            pair.pop(j, None)
            renew(i)
            renew(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def _merge_bucket(self, pieces, rows, width, out) -> None:
        lengths = np.array([len(pieces[i]) for i in rows])
        ids = np.full((len(rows), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        rows = np.array(rows)
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)  # the first minimum is the leftmost
            best = ranks[np.arange(len(rows)), at]
            done = best >= NONE
            for r, line, n in zip(rows[done], ids[done], lengths[done], strict=True):
                out[r] = line[:n].tolist()
            go = ~done
            rows, ids, ranks, at, best, lengths = rows[go], ids[go], ranks[go], at[go], best[go], lengths[go] - 1
            if not len(rows):
                return
            width = int(lengths.max()) + 1
            ids, ranks, columns = ids[:, :width], ranks[:, : width - 1], columns[:width]
            n = np.arange(len(rows))
            # compaction: what stands right of the merged pair moves one to the left
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            ids[n, at] = best
            source = np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NONE
            left = np.maximum(at - 1, 0)
            ranks[n, left] = np.where(at > 0, self.pairs.get(ids[n, left], ids[n, at]), ranks[n, left])
            right = np.minimum(at + 1, width - 1)
            new = np.where(at + 1 < width, self.pairs.get(ids[n, at], ids[n, right]), NONE)
            inside = at < width - 1
            ranks[n[inside], at[inside]] = new[inside]

    def learn(self, pieces: set[str]) -> None:
        """Encodes the strings not met before and remembers ids and decoded bytes."""
        if len(self.known) > CACHE_STRINGS:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        for p, ids in zip(new, self.merge([p.encode() for p in new]), strict=True):
            self.known[p] = (len(ids), ",".join(map(str, ids)), self.decode(ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        return [i for ids in self.merge([p.encode() for p in pieces]) for i in ids]

    def digests(self, texts: list[str], slice_pieces: int = 1_000_000) -> list[tuple[int, str, str]]:
        """For each text: number of ids, sha256 of the id list and of the decoded bytes.

        The strings of many short texts are learnt together, so that the matrices are tall;
        a long text is split and hashed slice by slice, never held as a whole list."""
        out, held, size = [], [], 0
        for text in texts:
            if len(text) > slice_pieces:
                out += [self._digest([p]) for p in held]
                held, size = [], 0
                out.append(self._digest(self._slices(text, slice_pieces)))
                continue
            held.append(self.pieces(text))
            size += len(held[-1])
            if size >= slice_pieces or len(texts) == len(out) + len(held):
                self.learn(set().union(*held))
                out += [self._digest([p], learnt=True) for p in held]
                held, size = [], 0
        return out + [self._digest([p]) for p in held]

    def _slices(self, text: str, step: int):
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, step)):
            yield part

    def _digest(self, slices, learnt: bool = False) -> tuple[int, str, str]:
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
        for part in slices:
            if not learnt:
                self.learn(set(part))
            if part:
                counts, ids, raw = zip(*map(self.known.__getitem__, part), strict=True)
                ids_sha.update((("," if n else "") + ",".join(ids)).encode())
                n += sum(counts)
                text_sha.update(b"".join(raw))
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), pattern))

    def run(batches):
        bpe = ByteBpe(*shared.value)
        for b in batches:
            rows = bpe.digests([t.as_py() or "" for t in b[text_col]])
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
