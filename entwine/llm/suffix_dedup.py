"""Repeated passages by suffix order and longest previous factors.

A passage is a byte string of ``length`` bytes that starts in two places of the
corpus (matches never cross texts).  Every such string contains the same least
``ANCHOR``-byte gram, so places that hold it meet under that gram's hash:

1. One scan finds each window's least gram.  Neighbouring windows with one gram
   form an item of less than two lengths, about two items per ``length`` bytes.
   Only hashes, digests and places of items are written.
2. Grams that occur once end here.  If all items of a gram are equal by a
   128-bit BLAKE2b digest of their bytes, their windows are repeated without
   further ado.  The others are mixed: equal items collapse to one, and the bytes
   of that one are fetched.
3. A mixed gram with over ``GROUP`` items is split: its windows by halves of
   their distance to the gram, its items by the bytes all windows of a half
   share.  That is repeated, at most nine times, until groups are small, equal
   or single, so no task holds a hot gram.
4. Within a task the windows are put in suffix order (by prefix doubling, to
   ``length`` bytes, then by place).  The previous and next smaller places in
   that order give each window's longest previous factor, and the same with
   places reversed the longest next one.
5. ``mode="later"`` removes what an earlier factor covers, so the first copy
   stays; ``mode="all"`` also removes what a later one covers.

Nulls are empty texts.  A null id is an id of its own, lower than any other.
Rows that repeat an id and a text are separate places with one result.  An empty
table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import Scratch, byte_view, mix64, task

LENGTH, ANCHOR = 400, 32
#: Items of a gram that go to one task; bytes of one suffix order.
GROUP, ORDER_BYTES = 2048, 2 << 20
#: Buckets of the filter that keeps texts without a part in it out of a shuffle.
BUCKETS = 1 << 20
_PIECE_BITS = 20
_LOWEST = np.iinfo(np.int64).min
_MULT = 0x5851F42D4C957F2D
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        n = (1 << _PIECE_BITS) + 1
        _powers.extend(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(x))]) for x in (_MULT, pow(_MULT, -1, 1 << 64)))
    return _powers


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks to both sides."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def find_items(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Items of joined texts of at most 2**_PIECE_BITS bytes: text, first window, gram's place in it, windows, key, and the halves of the BLAKE2b digest of its bytes and shape."""
    size = np.diff(offsets)
    n, per = len(data), size - length + 1
    owner = np.repeat(np.arange(len(size)), np.maximum(per, 0))
    if not len(owner):
        e = np.zeros(0, np.int64)
        return e, e, e, e, e, e, e
    power, inverse = _power_tables()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
    gram = mix64((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    mask = np.uint64((1 << _PIECE_BITS) - 1)
    least = sliding_least((gram & ~mask) | np.arange(len(gram), dtype=np.uint64), length - ANCHOR + 1)
    first = np.cumsum(np.maximum(per, 0)) - np.maximum(per, 0)
    window = np.arange(len(owner)) - first[owner] + offsets[:-1][owner]
    at = (least[window] & mask).astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]
    head = np.flatnonzero(new)
    count = np.diff(np.r_[head, len(at)])
    start, at, owner = window[head], at[head], owner[head]
    end = start + count - 1 + length
    raw = memoryview(np.ascontiguousarray(data))
    digest = np.frombuffer(b"".join([blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    shape = mix64((at - start).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)).view(np.int64)
    return owner, start - offsets[:-1][owner], at - start, count, gram[at].view(np.int64), digest[:, 0] ^ shape, digest[:, 1] ^ shape


def _pieces(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, place in it, bytes, offsets): texts joined, or a part of a long one with the overlap its last window needs."""
    cap = 1 << _PIECE_BITS
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > cap:
            step = cap - length + 1
            for a in range(int(off[i]), int(off[i + 1]) - length + 1, step):
                b = min(int(off[i + 1]), a + cap)
                yield i, a - int(off[i]), data[a:b], np.array([0, b - a])
            i += 1
            continue
        j = int(np.searchsorted(off, off[i] + cap, side="right")) - 1
        yield i, 0, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_ITEM = pa.struct([("start", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
_DOCS = "doc_id long, doc long, row long, n_bytes long, sha string, items array<struct<start:long,at:int,n:int,key:long,d1:long,d2:long>>"


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                data, off = byte_view(b.column(3))
                parts = []
                for i, place, piece, o in _pieces(data, off, length):
                    owner, start, *rest = find_items(piece, o, length)
                    parts.append((owner + i, start + place, *rest))
                cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 7
                items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols[1:], _ITEM, strict=True)], fields=list(_ITEM))
                ends = np.searchsorted(cols[0], np.arange(b.num_rows + 1)).astype(np.int32)
                raw = memoryview(np.ascontiguousarray(data))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(np.diff(off)), pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string()), pa.ListArray.from_arrays(pa.array(ends), items)],
                    names=["doc_id", "doc", "row", "n_bytes", "sha", "items"],
                )

    return run


_PARTS = "item long, doc long, start long, at int, n int, key long, total long, body binary"


def _cut_items(length: int):
    """(texts with their wanted items) to the items' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                for w in wanted:
                    for c, v in zip(cols, (w["item"], w["doc"], w["start"], w["at"], w["n"], w["key"], w["total"], raw[w["start"] : w["start"] + w["n"] - 1 + length]), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item", "doc", "start", "at", "n", "key", "total", "body"])

    return run


_HALVES = "item long, doc long, start long, low int, high int, at int, n int, key long, digest binary, body binary"


def _halve(length: int):
    """Split items (with their range of distances low..high) in two; the key is what all windows of a half share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for item, doc, start, low, high, at, n, key, body in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                mid = (low + high) // 2
                for lo, hi in ((low, mid), (mid + 1, high)):
                    # windows w have the gram at distance at - w
                    w0, w1 = max(0, at - hi), min(n - 1, at - lo)
                    if lo > hi or w0 > w1:
                        continue
                    core = body[at - lo : at - hi + length]
                    name = hashlib.blake2b(core, digest_size=8, key=key.to_bytes(8, "little", signed=True) + lo.to_bytes(4, "little") + hi.to_bytes(4, "little")).digest()
                    part = body[w0 : w1 + length]
                    shape = (at - w0).to_bytes(4, "little") + (w1 - w0).to_bytes(4, "little")
                    out.append((item, doc, start + w0, lo, hi, at - w0, w1 - w0 + 1, int.from_bytes(name, "little", signed=True), hashlib.blake2b(part, digest_size=16, salt=shape).digest(), part))
            cols = list(zip(*out, strict=True)) or [[]] * 10
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _HALVES.split(", ")])

    return run


def suffix_order(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose first ``length`` bytes occur twice, in the order of those bytes and then of place; and their rank.

    ``ends`` is the end of each place's text.  Ranks double in length; a place
    leaves as soon as its prefix is unique.
    """
    live = np.flatnonzero(np.arange(len(data)) + length <= ends)
    if not len(live):
        return live, live
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(">u8")[:, 0].astype(np.uint64)
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64) if len(word) else word
    have = 8
    while True:
        count = np.bincount(rank[rank >= 0])
        single = rank < 0  # unique already, or not carried on
        single[rank >= 0] = count[rank[rank >= 0]] == 1
        live = live[~single[live]]
        if have == length or not len(live):
            break
        step = min(have, length - have)
        live = live[~single[live + step]]
        grow = np.flatnonzero(np.arange(len(data)) + have + step <= ends) if have + step < length else live
        grow = grow[~single[grow] & ~single[grow + step]]
        key = rank[grow].astype(np.uint64) << np.uint64(32) | rank[grow + step].astype(np.uint64)
        nxt = np.full(len(rank), -1, np.int64)
        nxt[grow] = np.unique(key, return_inverse=True)[1]
        live = live[nxt[live] >= 0]
        rank, have = nxt, have + step
    order = live[np.lexsort((live, rank[live]))]
    return order, rank[order]


def nearest_smaller(place: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each entry of a suffix order the nearest entry before it, in its run, with a smaller place; -1 if none. By pointer jumping."""
    near = np.arange(len(place)) - 1
    near[(near < 0) | (run[near] != run)] = -1
    todo = np.flatnonzero(near >= 0)
    todo = todo[place[near[todo]] > place[todo]]
    while todo.size:
        up = near[near[todo]]
        near[todo] = up
        todo = todo[up >= 0]
        todo = todo[place[near[todo]] > place[todo]]
    return near


def previous_factors(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each entry's longest previous factor reaches the length: a smaller place precedes or follows it in its run."""
    before = nearest_smaller(order, rank)
    after = nearest_smaller(order[::-1], rank[::-1])[::-1]
    return (before >= 0) | (after >= 0)


_RANGES = "item long, first long, last long"


def _ranges(item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows, of sorted (item, place)."""
    new = np.r_[True, (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)] if len(item) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(item)] - 1 if len(head) else head
    return item[head], place[head], place[tail]


def _match(length: int, both: bool):
    """Rows (key, doc, start, item, body) in the order of key to ranges of repeated windows."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("doc", "ascending"), ("start", "ascending"), ("item", "ascending")])
        cols = [rows.column(c).to_numpy() for c in ("doc", "start", "item")]
        # a row that repeats id and text brings its items twice
        rows = rows.filter(pa.array(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
        data, off = byte_view(rows.column("body").cast(pa.large_binary()))
        size = np.diff(off)
        order, rank = suffix_order(data, np.repeat(off[1:], size), length)
        hit = previous_factors(order, rank)
        if both:
            hit |= previous_factors(-order, rank)
        at = np.sort(order[hit])
        owner = np.searchsorted(off, at, side="right") - 1
        place = rows.column("start").to_numpy()[owner] + at - off[owner]
        item = rows.column("item").to_numpy()[owner]
        turn = np.lexsort((place, item))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _ranges(item[turn], place[turn])], names=["item", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            lens = np.diff(byte_view(b.column(4))[1])
            cut = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, b.num_rows]
            begin = 0
            total = np.r_[0, np.cumsum(lens)]
            for s in cut[:-1].tolist():
                # a new key starts at s: what is held may be settled
                if size + total[s] - total[begin] > ORDER_BYTES and keys[s] != (last if s == 0 else keys[s - 1]):
                    if s > begin:
                        held.append(b.slice(begin, s - begin))
                    yield settle(pa.Table.from_batches(held))
                    held, size, begin = [], 0, s
            held.append(b.slice(begin))
            size += int(total[-1] - total[begin])
            last = keys[-1]
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


_RESULT = "doc_id long, doc long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc, row, text, ranges of bytes) to what is left."""
    for b in batches:
        out = []
        for text, ranges in zip(b.column(3), b.column(4).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            spans: list[list[int]] = []
            for r in sorted((r["first"], r["last"]) for r in ranges):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            left, at = [], 0
            for a, z in spans:
                left.append(raw[at:a])
                at = z
            left.append(raw[at:])
            kept = b"".join(left)
            out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"first": a, "last": z} for a, z in spans]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "doc", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose (doc, row) may be wanted; the filter has at most BUCKETS rows, so it may be broadcast."""
    bucket = F.pmod(F.xxhash64("doc", "row"), F.lit(BUCKETS)).cast("int")
    return texts.withColumn("__b", bucket).join(F.broadcast(wanted.select(bucket.alias("__b")).distinct()), "__b", "left_semi").drop("__b")


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, mode: str = "all", group: int = GROUP) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the removed ``spans`` (bytes, end exclusive)."""
    if length < 2 * ANCHOR or mode not in ("all", "later"):
        raise ValueError("length must be at least two anchors and mode 'all' or 'later'")
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark, "suffix-dedup")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(int(_LOWEST))).alias("doc"), F.xxhash64("text").alias("row"), "text")
    docs = scratch.put("docs", rows.mapInArrow(task(_scan(length)), _DOCS))
    items = docs.select("doc", "row", F.inline("items"))
    place = F.struct("doc", "start", "row")
    later = mode == "later"
    least = lambda p: F.min(p).alias("least")
    # grams that occur more than once, and whether their items are all equal; written, so that AQE may split the joins on hot ones
    grams = items.groupBy("key").agg(F.count("*").alias("total"), F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.min("d2").alias("lo2"), F.max("d2").alias("hi2"), *([least(place)] if later else []))
    grams = grams.where("total > 1").select("key", ((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2"))).alias("equal"), *(["least"] if later else []))
    grams = scratch.put("grams", grams)
    met = scratch.put("met", items.join(grams, "key"))
    whole = met.where("equal").where(place != F.col("least")) if later else met.where("equal")
    marks = whole.select("doc", "row", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
    mixed = met.where("not equal").select("doc", "row", "start", "at", "n", "key", "d1", "d2")
    same = ["key", "d1", "d2"]
    # of equal items of a mixed gram, the first stands for all
    ones = mixed.groupBy(*same).agg(F.count("*").alias("copies"), F.min(F.struct("doc", "start", "row", "at", "n")).alias("one"))
    ones = scratch.put("ones", ones.select(F.monotonically_increasing_id().alias("item"), *same, "copies", "one.*"))
    groups = scratch.put("groups", ones.groupBy("key").agg(F.count("*").alias("total")))
    wanted = ones.join(groups, "key").groupBy("doc", "row").agg(F.collect_list(F.struct("item", "doc", "start", "at", "n", "key", "total")).alias("wanted"))
    wanted = scratch.put("wanted", wanted)
    texts = _only(rows, wanted.select("doc", "row")).select("doc", "row", "text").join(wanted, ["doc", "row"]).select("text", "wanted")
    bodies = scratch.put("bodies", texts.mapInArrow(task(_cut_items(length)), _PARTS), compression="zstd")
    ready = [bodies.where(F.col("total") <= group).select("key", "doc", "start", "item", "body")]
    found = []
    hot = bodies.where(F.col("total") > group).select("item", "doc", "start", F.lit(0).alias("low"), F.lit(length - ANCHOR).alias("high"), "at", "n", "key", "body")
    step = 0
    while not hot.isEmpty():
        step += 1
        half = scratch.put(f"half-{step}", hot.mapInArrow(task(_halve(length)), _HALVES), compression="zstd")
        at = F.struct("doc", "start", "item")
        sizes = half.groupBy("key").agg(F.count("*").alias("total"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), *([least(at)] if later else [])).where("total > 1")
        sizes = scratch.put(f"sizes-{step}", sizes.select("key", "total", (F.col("lo") == F.col("hi")).alias("equal"), *(["least"] if later else [])))
        split = scratch.put(f"split-{step}", half.join(sizes, "key"), compression="zstd")
        whole = split.where("equal").where(at != F.col("least")) if later else split.where("equal")
        found.append(whole.select("item", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")))
        rest = split.where("not equal")
        ready.append(rest.where(F.col("total") <= group).select("key", "doc", "start", "item", "body"))
        hot = rest.where(F.col("total") > group).select("item", "doc", "start", "low", "high", "at", "n", "key", "body")
        scratch.drop(f"half-{step}")
    dealt = ready[0]
    for r in ready[1:]:
        dealt = dealt.unionByName(r)
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("key")
    ranges = dealt.mapInArrow(task(_match(length, not later)), _RANGES)
    for f in found:
        ranges = ranges.unionByName(f)
    ranges = scratch.put("ranges", ranges)
    # what holds for the first of equal items holds for all, at their own places
    first = ones.select("item", *same, F.col("start").alias("base"), F.struct("doc", "start", "row").alias("one"), "copies")
    shift = F.col("start") - F.col("base")
    placed = scratch.put("placed", ranges.join(first, "item"))
    spread = mixed.join(placed, same)
    if later:
        spread = spread.where(place == F.col("one"))
    marks = marks.unionByName(spread.select("doc", "row", (F.col("first") + shift).alias("first"), (F.col("last") + shift).alias("last")))
    copied = mixed.join(first.where("copies > 1"), same)
    if later:
        copied = copied.where(place != F.col("one"))
    marks = marks.unionByName(copied.select("doc", "row", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")))
    marks = marks.groupBy("doc", "row").agg(F.collect_set(F.struct("first", (F.col("last") + length).alias("last"))).alias("ranges"))
    marks = scratch.put("marks", marks)
    cut = _only(rows, marks.select("doc", "row")).join(marks, ["doc", "row"]).select("doc_id", "doc", "row", "text", "ranges")
    changed = scratch.put("changed", cut.mapInArrow(task(_remove), _RESULT))
    for name in ("grams", "met", "groups", "wanted", "bodies", "ranges", "placed"):
        scratch.drop(name)
    once = changed.select("doc", "row", "n_removed", "n_spans", "kept_sha256", "spans").groupBy("doc", "row").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "spans")])
    out = docs.select("doc_id", "doc", "row", "n_bytes", "sha").join(once, ["doc", "row"], "left")
    none = F.array().cast("array<struct<first:long,last:long>>")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", none).alias("spans"))
