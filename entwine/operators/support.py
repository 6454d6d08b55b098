"""Support of a pair (s, c) by the entity's other candidates that are linked to c.

Walking every pair to all neighbours of its candidate makes many times more rows
than there are pairs, and few of them arrive at a pair.  So nothing is walked over
a shuffle: entities are packed in chunks with all their pairs, edges in blocks by
the candidate they lead to, and every chunk meets every block.  A pair lies in one
chunk and its candidate in one block, so its support is whole where the two meet.
Chunks meet blocks in number of both, and a task holds one of each; the neighbours
of one candidate lie in one block.  Entities with more pairs than a chunk holds
take the plain join.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from entwine.scratch import Scratch

CHUNK_ROWS, BLOCK_EDGES, WALK_STEPS, FILTER_BITS = 1 << 20, 3 << 20, 1 << 19, 22

_SUPPORT = [StructField("sup_max", DoubleType()), StructField("sup_mean", DoubleType()), StructField("sup_deg", LongType()), StructField("sup_n70", LongType())]


def _tidy(run: Callable) -> Callable:
    """``run`` over the batches of a partition; what it held goes back to the system, as Python workers are used again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def group_lists(members: DataFrame, group: str, member: str, scratch: Scratch) -> DataFrame:
    """(b, near) of members that share a group: each with the others, once a group. The groups are written."""
    held = members.select(F.col(group).alias("g"), F.col(member).alias("m")).where(F.col("g").isNotNull() & F.col("m").isNotNull())
    sets = held.repartition("g").groupBy("g").agg(F.collect_set("m").alias("m")).where(F.size("m") > 1).select("m")
    sets = scratch.put("groups", sets, compression="zstd", last=True)
    return sets.select(F.explode("m").alias("b"), "m").select("b", F.array_remove("m", F.col("b")).alias("near"))


def _pack(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(x: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(x.as_buffer()).read_all()


def _plain(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.to_numpy(zero_copy_only=False)


def _smallest(x: np.ndarray, top: int) -> np.ndarray:
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of both columns, and the distinct rows by ``a`` as places among them."""
    a_keys, ai = np.unique(a, return_inverse=True)
    b_keys, bi = np.unique(b, return_inverse=True)
    codes = np.sort(ai.astype(np.int64) * max(1, len(b_keys)) + bi)
    codes = codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes
    ai, bi = np.divmod(codes, max(1, len(b_keys)))
    return a_keys, b_keys, ai, bi


def _edge_blocks(most: int) -> Callable:
    """Rows (bucket, b, near) by bucket to one block a bucket: the edges from each a, as places among the block's b."""

    def block(bucket: int, parts: list, kind: pa.DataType) -> pa.RecordBatch:
        a, b = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (list(zip(*parts, strict=True)) or ((), ())))
        a_keys, b_keys, ai, bi = _distinct(a, b)
        n = np.bincount(ai, minlength=len(a_keys))
        froms = pa.table({"a": pa.array(a_keys if len(n) else [], kind), "n": _smallest(n, int(n.max(initial=0)))})
        row = [[bucket], [_pack(froms)], [_pack(pa.table({"b": pa.array(b_keys if len(n) else [], kind)}))], [_pack(pa.table({"to": _smallest(bi, len(b_keys))}))]]
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["bucket", "froms", "keys", "tos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size, limit, kind = None, [], 0, 2 * most, None
        for x in batches:
            if not x.num_rows:
                continue
            kind = x.column(1).type
            buckets = x.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if buckets[lo] != now:
                    if now is not None:
                        yield block(now, parts, kind)
                    now, parts, size, limit = int(buckets[lo]), [], 0, 2 * most
                some = x.slice(lo, hi - lo)
                some = some.filter(some.column(1).is_valid())
                near = some.column(2)
                if not some.num_rows or not len(near.flatten()):
                    continue
                n = np.diff(near.offsets.to_numpy())
                parts.append((_plain(near.flatten()), np.repeat(_plain(some.column(1)), n)))
                size += len(parts[-1][0])
                if size > limit:  # pairs that many groups share
                    a_keys, b_keys, ai, bi = _distinct(*(np.concatenate(z) for z in zip(*parts, strict=True)))
                    parts, size = [(a_keys[ai], b_keys[bi])], len(ai)
                    limit = max(limit, 2 * size)
        if now is not None:
            yield block(now, parts, kind)

    return run


def _chunks(s: str, c: str, buckets: int, most: int) -> Callable:
    """Rows by ``s`` to chunks of whole entities, rows by bucket; entities of over ``most`` rows (``__n``) lie apart."""

    def chunk(t: pa.Table, hot: bool) -> pa.RecordBatch:
        t = t.take(np.argsort(_plain(t["__b"]), kind="stable"))
        at = np.searchsorted(_plain(t["__b"]), np.arange(buckets + 1)).astype(np.int32)
        walk = np.flatnonzero(_plain(t["__w"]) & _plain(t[s].is_valid()) & _plain(t[c].is_valid()))
        walk = walk[np.argsort(_plain(t[c].take(walk)), kind="stable")].astype(np.int32)
        rows = t.drop_columns(["__b", "__w", "__n"]).append_column("__s", pa.array(entities(t)))
        values = [pa.array([hot]), *(pa.array([x], pa.binary()) for x in (at.tobytes(), _pack(rows), _pack(pa.table({"w": walk}))))]
        return pa.RecordBatch.from_arrays(values, names=["hot", "at", "rows", "walk"])

    def entities(t: pa.Table) -> np.ndarray:
        """A number for each entity, -1 without."""
        return t[s].combine_chunks().dictionary_encode().indices.fill_null(-1).cast(pa.int32()).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in batches:
            hot = _plain(x.column("__n")) > most
            if hot.any():
                yield chunk(pa.Table.from_batches([x.filter(pa.array(hot))]), True)
                x = x.filter(pa.array(~hot))
            held.append(x)
            n += x.num_rows
            if n > most:
                t = pa.Table.from_batches(held).combine_chunks()
                codes = entities(t)
                new = np.flatnonzero(codes[1:] != codes[:-1]) + 1
                if len(new):
                    yield chunk(t.slice(0, int(new[-1])), False)
                    t = t.slice(int(new[-1]))
                held, n = t.to_batches(), t.num_rows
        if n:
            yield chunk(pa.Table.from_batches(held).combine_chunks(), False)

    return run


def _meet(c: str, p: str, names: list[str], steps: int) -> Callable:
    """Rows (block, chunk) to the chunk's pairs whose candidate is of the block's bucket, with their support."""

    def support(rows: pa.Table, lo: int, hi: int, walk: np.ndarray, edges: tuple) -> list[np.ndarray]:
        a_keys, n, start, b_keys, tos = edges
        out = [np.zeros(hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)]
        if not len(a_keys) or not len(walk):
            return out
        codes = _plain(rows["__s"])
        here = lo + np.flatnonzero(_plain(rows[c].slice(lo, hi - lo).is_valid()) & (codes[lo:hi] >= 0))
        ids = _plain(rows[c].take(here))
        at = np.minimum(np.searchsorted(b_keys, ids), len(b_keys) - 1)
        linked = b_keys[at] == ids
        here, at = here[linked], at[linked]
        width = np.int64(len(b_keys))
        keys, pair = np.unique(codes[here].astype(np.int64) * width + at, return_inverse=True)
        if not len(keys):
            return out
        mask = np.int64((1 << FILTER_BITS) - 1)
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[keys & mask] = True
        ids = _plain(rows[c].take(walk))
        at = np.minimum(np.searchsorted(a_keys, ids), len(a_keys) - 1)
        linked = a_keys[at] == ids
        walk, at = walk[linked], at[linked]
        q, base = _plain(rows[p].take(walk).cast(pa.float64())), codes[walk].astype(np.int64) * width
        n, start = n[at], start[at]
        ends = np.cumsum(n)
        best, total, deg, high = np.full(len(keys), -np.inf), np.zeros(len(keys)), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        i = 0
        while i < len(walk):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + steps)))
            m = n[i:j]
            place = np.arange(int(ends[j - 1] - done)) + np.repeat(start[i:j] - (ends[i:j] - m - done), m)
            key = np.repeat(base[i:j], m) + tos[place]
            found = np.flatnonzero(maybe[key & mask])
            key = key[found]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[k] == key
            k, w = k[same], q[i + np.searchsorted(ends[i:j] - done, found[same], side="right")]
            np.maximum.at(best, k, w)
            total += np.bincount(k, weights=w, minlength=len(keys))
            deg += np.bincount(k, minlength=len(keys))
            high += np.bincount(k[~(w < 0.7)], minlength=len(keys))
            i = j
        some = deg > 0
        for x, v in zip(out, (np.where(some, best, 0.0), total / np.maximum(deg, 1), deg, high), strict=True):
            x[here - lo] = v[pair]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edges = None, ()
        for x in batches:
            for i in range(x.num_rows):
                e, k = x.column(0)[i], x.column(1)[i]
                bucket = e["bucket"].as_py()
                at = np.frombuffer(k["at"].as_buffer(), np.int32)
                lo, hi = int(at[bucket]), int(at[bucket + 1])
                if lo == hi:
                    continue
                if bucket != now:
                    froms = _unpack(e["froms"])
                    n = _plain(froms["n"]).astype(np.int64)
                    now, edges = bucket, (_plain(froms["a"]), n, np.cumsum(n) - n, _plain(_unpack(e["keys"])["b"]), _plain(_unpack(e["tos"])["to"]))
                rows = _unpack(k["rows"])
                out = support(rows, lo, hi, _plain(_unpack(k["walk"])["w"]), edges)
                t = rows.slice(lo, hi - lo).select(names)
                for name, v in zip(("sup_max", "sup_mean", "sup_deg", "sup_n70"), out, strict=True):
                    t = t.append_column(name, pa.array(v))
                yield from t.to_batches()

    return run


def _open_rows(names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                yield from _unpack(x.column(0)[i]).select(names).to_batches()

    return run


def _open_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for i in range(x.num_rows):
            froms, keys, tos = (_unpack(x.column(k)[i]) for k in range(3))
            a = froms["a"].combine_chunks().take(np.repeat(np.arange(froms.num_rows), _plain(froms["n"])))
            b = keys["b"].combine_chunks().take(tos["to"].combine_chunks()) if keys.num_rows else keys["b"].combine_chunks()
            yield from pa.table({"a": a, "b": b}).to_batches(max_chunksize=1 << 16)


def plain_support(df: DataFrame, edges: DataFrame, p: str, s: str, c: str, support: float) -> DataFrame:
    """The same by a join of all walked rows; ``edges`` (a, b) holds an edge once."""
    walk = df.where(F.col(p) >= support).select(F.col(s).alias("__s"), F.col(c).alias("a"), F.col(p).cast("double").alias("q"))
    sup = walk.join(edges, "a").groupBy(F.col("__s").alias(s), F.col("b").alias(c)).agg(
        F.max("q").alias("sup_max"), F.avg("q").alias("sup_mean"), F.count(F.lit(1)).alias("sup_deg"), F.sum((F.col("q") >= 0.7).cast("long")).alias("sup_n70")
    )
    zero = lambda x: F.coalesce(F.col(x.name), F.lit(0).cast(x.dataType)).alias(x.name)
    return df.join(sup, [s, c], "left").select(*df.columns, *[zero(x) for x in _SUPPORT])


def with_support(df: DataFrame, edges: DataFrame, p: str, s: str, c: str, support: float, chunk_rows: int = CHUNK_ROWS, block_edges: int = BLOCK_EDGES, steps: int = WALK_STEPS) -> DataFrame:
    """``df`` with sup_max, sup_mean, sup_deg and sup_n70: over the entity's pairs of at least ``support`` whose candidate has an edge to c.

    ``edges`` is (a, b), or (b, near) with the list of a; repeated edges count once.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "support")
    kind = df.schema[c].dataType
    if "near" not in edges.columns:
        edges = edges.where("a IS NOT NULL").select("b", F.array("a").alias("near"))
    lists = edges.select(F.col("b").cast(kind).alias("b"), F.col("near").cast(f"array<{kind.simpleString()}>").alias("near"))
    buckets = max(1, -(-int(lists.agg(F.sum(F.size("near"))).first()[0] or 0) // block_edges))
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast(kind).alias("b"), F.array().cast(f"array<{kind.simpleString()}>").alias("near"))
    dealt = lists.where("b IS NOT NULL").select(bucket("b").alias("bucket"), "b", "near").unionByName(each).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    blocks = scratch.put("edges", dealt.mapInArrow(_tidy(_edge_blocks(block_edges)), "bucket int, froms binary, keys binary, tos binary"), "none", last=True)

    here = F.count(F.lit(1)).over(Window.partitionBy(s))  # whole entities in a partition, one after the other
    flagged = df.withColumns({"__n": here, "__b": bucket(c), "__w": F.coalesce(F.col(p) >= support, F.lit(False))})
    chunks = scratch.put("chunks", flagged.mapInArrow(_tidy(_chunks(s, c, buckets, chunk_rows)), "hot boolean, at binary, rows binary, walk binary"), "none", last=True)

    out = StructType([*df.schema.fields, *_SUPPORT])
    count = {r.hot: r.n for r in chunks.groupBy("hot").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = blocks.select(F.struct(*blocks.columns).alias("e"))
    right = chunks.where("NOT hot").select(F.struct("at", "rows", "walk").alias("k")).coalesce(max(2, -(-count.get(False, 0) // 4)))
    met = scratch.put("met", left.crossJoin(right).mapInArrow(_tidy(_meet(c, p, df.columns, steps)), out), last=True, batch_bytes=1 << 20)  # a chunk and a block at a time
    if count.get(True):
        rows = chunks.where("hot").select("rows").mapInArrow(_open_rows(df.columns), df.schema)
        pairs = blocks.select("froms", "keys", "tos").mapInArrow(_open_edges, StructType([StructField("a", kind), StructField("b", kind)]))
        return met.unionByName(plain_support(rows, pairs, p, s, c, support))
    scratch.drop("edges", "chunks")
    return met
