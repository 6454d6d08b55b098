"""Byte-level BPE by rounds over padded matrices.

Distinct pre-tokens are laid out by length class as padded numpy matrices.  In
every round each row merges its leftmost pair of least rank; pairs are looked up
in an open-addressing hash table; rows without a pair leave the matrix, which is
compacted.  A round costs a row its width, so a row of n bytes costs n squared;
pre-tokens over ``LONG`` bytes (text without blanks, base64) are therefore merged
in the same order, leftmost pair of least rank first, through a heap in n log n.

A null text is empty and has no ids.  Texts of any length are encoded whole.
Repeated rows give repeated results and an empty table an empty one.  Only the
id and text columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import task

NO_PAIR = np.iinfo(np.int32).max
#: Pre-tokens above this many bytes are merged through a heap.
LONG = 512
#: Bounds of the per-worker memo (entries) and of one encoding step (pre-tokens held).
MEMO, STEP = 400_000, 400_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) to rank, by multiplicative hashing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        ids = np.array(merged, np.int32)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ids = np.full(1 << bits, NO_PAIR, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while rest.size:
            free = self.keys[slot[rest]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(slot[rest], return_index=True)
            won = np.zeros(len(rest), bool)
            won[one] = True
            won &= free
            self.keys[slot[rest[won]]], self.ids[slot[rest[won]]] = keys[rest[won]], ids[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLDEN) >> self.shift).astype(np.int64)

    @functools.cached_property
    def _known(self) -> dict[int, int]:
        held = self.ids != NO_PAIR
        return dict(zip(self.keys[held].tolist(), self.ids[held].tolist(), strict=True))

    def pair(self, left: int, right: int) -> int:
        """Rank of one pair."""
        return self._known.get(left << 32 | right, NO_PAIR)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, NO_PAIR where there is none or an id is negative."""
        shape = left.shape
        key = (left.ravel().astype(np.uint64) << np.uint64(32)) | (right.ravel().astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(key.size, NO_PAIR, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(key[todo])
        while todo.size:
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.ids[slot[hit]]
            go = ~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.table = PairTable(ranks)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.memo: dict[str, bytes] = {}

    def _long(self, token: bytes) -> np.ndarray:
        """One row merged by a heap of (rank, place); a merge touches two neighbouring pairs, so it takes n log n."""
        ids = self.first[np.frombuffer(token, np.uint8)].tolist()
        ranks = self.table.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        known = np.flatnonzero(ranks != NO_PAIR)
        heap = list(zip(ranks[known].tolist(), known.tolist(), strict=True))
        heapify(heap)
        pair = self.table.pair
        rank = ranks.tolist() + [NO_PAIR]  # of the pair that begins at each place
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        while heap:
            least, at = heappop(heap)
            if rank[at] != least:
                continue  # the pair has changed
            gone = after[at]
            ids[at], rank[gone], ids[gone] = least, NO_PAIR, -1
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            for place in (before[at], at):
                if place < 0:
                    continue
                rank[place] = pair(ids[place], ids[after[place]]) if after[place] >= 0 else NO_PAIR
                if rank[place] != NO_PAIR:
                    heappush(heap, (rank[place], place))
        left = np.array(ids, np.int32)
        return left[left >= 0]

    def _rounds(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Merge a class of tokens of similar length; returns their ids in order."""
        n, width = len(tokens), max(map(len, tokens))
        length = np.array([len(t) for t in tokens])
        flat = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = flat
        rank = self.table.ranks(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(n), [None] * n
        while row.size:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(row.size, np.int64)
            least = rank[np.arange(row.size), at] if rank.shape[1] else np.full(row.size, NO_PAIR)
            over = least == NO_PAIR
            for i in np.flatnonzero(over):
                out[row[i]] = ids[i, : length[i]].copy()
            if over.any():
                row, ids, rank, length, at, least = row[~over], ids[~over], rank[~over], length[~over], at[~over], least[~over]
                if not row.size:
                    break
                width = length.max()
                ids, rank = ids[:, :width], rank[:, : width - 1]
            rows, cols = np.arange(row.size), np.arange(width)
            ids[rows, at] = least
            shift = cols[None, :] + (cols[None, :] > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), shift, axis=1)
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 2)), constant_values=NO_PAIR), shift, axis=1)[:, : width - 1]
            length = length - 1
            last = ids.shape[1] - 1
            for side in (at - 1, at):
                ok = (side >= 0) & (side < last)
                rank[rows[ok], side[ok]] = self.table.ranks(ids[rows[ok], side[ok]], ids[rows[ok], side[ok] + 1])
        return out

    def encode_tokens(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct pre-tokens; a whole token of the vocabulary is itself."""
        out: list = [None] * len(tokens)
        classes: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            whole = self.ranks.get(t)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(t) > LONG:
                out[i] = self._long(t)
            else:
                classes.setdefault(len(t).bit_length() if len(t) > 16 else -len(t), []).append(i)
        for size, members in classes.items():
            cut = max(1, (1 << 20) // (1 << size if size > 0 else -size))
            for s in range(0, len(members), cut):
                part = members[s : s + cut]
                for i, ids in zip(part, self._rounds([tokens[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def _learn(self, new: list[str], into: dict[str, bytes]) -> None:
        for t, ids in zip(new, self.encode_tokens([t.encode() for t in new]), strict=True):
            into[t] = ids.astype("<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned ids of every text."""
        out, held, size = [], [], 0

        def flush() -> None:
            nonlocal size
            if len(self.memo) > MEMO:
                self.memo = {}
            new = list({t for tokens in held for t in tokens}.difference(self.memo))
            memo = self.memo if len(new) <= MEMO else dict(self.memo)
            self._learn(new, memo)
            out.extend(b"".join(map(memo.__getitem__, tokens)) for tokens in held)
            held.clear()
            size = 0

        for text in texts:
            held.append(self.pattern.findall(text))
            size += len(held[-1])
            if size > STEP:
                flush()
        flush()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_SCHEMA = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def encode_texts(documents: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids`` (little-endian bytes, null unless kept), and digests of the ids and of their decoding."""
    shared = documents.sparkSession.sparkContext.broadcast((read_ranks(rank_path), pattern))  # as large as the rank file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBPE(*shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                ids = codec.encode_many([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids if keep_ids else [None] * len(ids), pa.binary()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task(run), _SCHEMA)


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the decoded ``bytes`` of a table with ``doc_id`` and ``ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast((read_ranks(rank_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBPE(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([codec.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(task(run), "doc_id long, bytes binary")
