"""Exact duplicate removal by distributed most-significant-byte radix partitioning.

Texts are split by successive bytes until every group is a single text or its
texts have ended, so equality is decided by the bytes and never by a digest.

1. Every Arrow batch is split locally.  Copies inside a batch collapse to one
   row, so a text that makes up a third of the corpus reaches the shuffle once
   a batch, not once a row.
2. The surviving texts are dealt by their leading bytes.  Prefixes with over
   ``HOT_BYTES`` of texts are extended (8, 32, 128, ... bytes) until they hold
   less or are whole texts.  They are a table that is joined, never a list of
   the driver's.  They are counted over the texts' places, not the texts, and
   only those below a level's hot prefixes are counted at the next.
3. A hot prefix that is a whole text needs no further byte: its rows are equal,
   and their partial sums meet in an aggregation.
4. Every task splits its bucket by successive bytes to the end.

Nulls count as empty texts and all empty texts are equal.  A null id is lower
than any other.  Repeated rows with one id are separate rows of a group; one of
them stays.  An empty table gives an empty result.  Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import Scratch, byte_view, free_names, lower_ascii, partitions_for, scratch_scope, task

#: Cells of a comparison window; bounds the memory of one radix pass.
WINDOW_CELLS = 1 << 22
#: Bytes of the first prefix; bytes of texts that make a prefix hot.
FIRST_BYTES, HOT_BYTES = 8, 1 << 19
#: Hot prefixes, of 8 bytes each, that are sent to all tasks; if there are more, the join to them shuffles the texts.
BROADCAST_ROWS = 1 << 20


def radix_groups(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the index of the first text that equals it.

    Each pass takes the next eight bytes of all open texts as one word, sorts
    by (group, word, whether the text ends in it), and closes groups that are single or ended.
    While all open texts agree with the first of their group, passes widen.
    """
    start, length = offsets[:-1], np.diff(offsets)
    label = np.arange(len(start))
    open_, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    at, width = 0, 8
    while open_.size > 1:
        left = length[open_] - at
        if width > 8 and open_.size * width <= WINDOW_CELLS and left.min() >= width:
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            lead = first[np.cumsum(np.r_[False, group[1:] != group[:-1]])]
            cells = data[(start[open_] + at)[:, None] + np.arange(width)]
            if (cells == cells[lead]).all():
                at, width = at + width, width * 2
                continue
            width = 8
        take = np.clip(left, 0, 9)  # 8 ends with this word, 9 goes on
        cells = data[np.minimum((start[open_] + at)[:, None] + np.arange(8), len(data) - 1)]
        cells[np.arange(8) >= take[:, None]] = 0
        word = cells.view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((open_, take, word, group))
        open_, word, take, group, left = open_[order], word[order], take[order], group[order], left[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]) | (take[1:] != take[:-1])]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(open_)])[group]
        ended = (left <= 8) & (size > 1)
        label[open_[ended]] = open_[first[group[ended]]]
        stay = (size > 1) & ~ended
        open_, group = open_[stay], group[stay]
        at += 8
        width = min(width * 2, max(8, WINDOW_CELLS // max(1, open_.size)))
    return label


def _best(label: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each row, row with the largest keys of each group)."""
    _, group = np.unique(label, return_inverse=True)
    order = np.lexsort((*keys[::-1], group))
    last = np.flatnonzero(np.r_[group[order][1:] != group[order][:-1], True]) if len(order) else order
    return group, order[last]


_LOCAL = "uid long, doc_id long, rep long, copies long, text binary, sha string"
_LOCAL_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("text", pa.binary()), ("sha", pa.string())])
_GROUP = "uid long, keep_uid long, keep_id long, group_size long, sha string"
_GROUP_ARROW = pa.schema([("uid", pa.int64()), ("keep_uid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("sha", pa.string())])
_SLIM = ("uid", "doc_id", "copies", "text", "sha")
_LOWEST = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(_LOWEST)).to_numpy(zero_copy_only=False)


def _collapse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, seen = TaskContext.get().partitionId() << 40, 0
    for b in batches:
        n = b.num_rows
        data, off = byte_view(b.column(1))
        data = lower_ascii(data)
        doc = _ids(b.column(0))
        uid = base + seen + np.arange(n)
        seen += n
        label = radix_groups(data, off)
        group, best = _best(label, doc, uid)
        copies = np.bincount(group, minlength=len(best))
        is_best = np.zeros(n, bool)
        is_best[best] = True
        raw = data.tobytes()
        text = [raw[off[i] : off[i + 1]] if is_best[i] else None for i in range(n)]
        sha = [None if t is None else hashlib.sha256(t).hexdigest() for t in text]
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid), b.column(0).cast(pa.int64()), pa.array(uid[best][group] if n else uid), pa.array(np.where(is_best, copies[group] if n else 0, 0)), pa.array(text, pa.binary()), pa.array(sha, pa.string())],
            schema=_LOCAL_ARROW,
        )


def _split_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of one task: (uid, doc_id, copies, text, sha) to groups."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    text = t.column("text")
    data, off = byte_view(text.cast(pa.large_binary()))
    doc, uid = _ids(t.column("doc_id").combine_chunks()), t.column("uid").to_numpy()
    group, best = _best(radix_groups(data, off), doc, uid)
    size = np.bincount(group, weights=t.column("copies").to_numpy(), minlength=len(best)).astype(np.int64)
    keep = pa.array(doc[best][group], mask=doc[best][group] == _LOWEST)
    out = pa.table([t.column("uid"), pa.array(uid[best][group]), keep, pa.array(size[group]), t.column("sha")], schema=_GROUP_ARROW)
    yield from out.to_batches(max_chunksize=20_000)


def _leading(width: int) -> Column:
    """Where a text is dealt by its first ``width`` bytes; texts that end there are apart from those that go on."""
    return F.xxhash64(F.substring("text", 1, width), F.length("text") > width)


def _width(level: int) -> int:
    return min(FIRST_BYTES * 4**level, (1 << 31) - 1)


def _reaches(level: int) -> Column:
    """Whether the text goes on beyond the level before, and so has a place at this one."""
    return F.length("text") > _width(level - 1) if level else F.lit(True)


def hot_prefixes(reps: DataFrame, scratch: Scratch, limit: int) -> list[tuple[int, DataFrame]]:
    """Levels (width, table of the places ``h`` of prefixes with over ``limit`` bytes of texts).

    Texts are read once, for their length ``n`` and their places at all levels
    (``h0``, ``h1``, ...; null beyond their end).  The places below a level's hot
    prefixes are written, as ``below-`` and its number.  Only those whose text goes on are
    counted at the next level, by four times the bytes; the last level's hot
    prefixes are whole texts.
    """
    depth = next(i for i in range(32) if _width(i) == (1 << 31) - 1) + 1
    at = scratch.put("places", reps.select(F.length("text").alias("n"), *(F.when(_reaches(i), _leading(_width(i))).alias(f"h{i}") for i in range(depth))))
    levels: list[tuple[int, DataFrame]] = []
    for i in range(depth):
        led = at.withColumnRenamed(f"h{i}", "h")
        sizes = led.groupBy("h").agg(F.sum(F.col("n") + 64).alias("b"))
        hot = scratch.put(f"hot-{i}", sizes.where(F.col("b") > limit).select("h"))
        found = hot.count()
        if not found:
            break
        hot = F.broadcast(hot) if found <= BROADCAST_ROWS else hot
        below = scratch.put(f"below-{i}", led.join(hot, "h", "left_semi").drop("h"))
        levels.append((_width(i), hot))
        at = below.where(F.col("n") > _width(i))
    return levels


def _dealt(reps: DataFrame, levels: list[tuple[int, DataFrame]], scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``radix``, the place of their shortest prefix that is not hot; rows whose whole text is a hot prefix, None without levels).

    What leads to a hot prefix is hot itself, so a row stands below a level if it
    is below the level before; it meets the prefixes of these two alone, and no
    text is written for it.  Both results depend on the text alone, so equal texts always meet.
    """
    if not levels:
        return reps.withColumn("radix", F.xxhash64(F.lit(0), _leading(_width(0)))), None
    at, dealt, level = reps, [], F.lit(len(levels))
    for i, (width, hot) in enumerate(levels):
        dealt.append(at.withColumn("h", _leading(width)).join(hot, "h", "left_anti").withColumn("radix", F.xxhash64(F.lit(i), "h")).drop("h"))
        at = reps.where(F.length("text") > width).withColumn("h", _leading(width)).join(hot, "h", "left_semi").drop("h")
    dealt.append(at.withColumn("radix", F.xxhash64(F.lit(len(levels)), _leading(_width(len(levels))))))
    for i, (width, _) in reversed(list(enumerate(levels))):
        level = F.when(F.length("text") <= width, F.lit(i)).otherwise(level)
    ends = reduce(DataFrame.unionByName, [scratch.spark.read.schema("h long").parquet(scratch.path(f"hot-{i}")).withColumn("level", F.lit(i)) for i in range(len(levels))])
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    whole = reps.withColumns({"h": F.xxhash64("text", F.lit(False)), "level": level}).join(ends, ["h", "level"], "left_semi").drop("h", "level")
    return reduce(DataFrame.unionByName, dealt), whole


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 32 << 20, limit: int = HOT_BYTES) -> DataFrame:
    """Group the rows by their text with A-Z lower-cased.

    Returns one row per input row: ``doc_id``, ``keep_id`` (largest id of the
    group), ``group_size``, ``kept`` and ``text_sha256`` (a result column; it
    plays no part in the grouping).
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = scratch.put("local", rows.mapInArrow(task(_collapse_batches), _LOCAL))
    reps = local.where(F.col("text").isNotNull()).select(*_SLIM)
    total = reps.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    parts = partitions_for(spark, total, task_bytes)
    dealt, same = _dealt(reps, hot_prefixes(reps, scratch, limit), scratch)
    groups = dealt.repartition(parts, "radix").select(*_SLIM).mapInArrow(task(_split_bucket), _GROUP)
    if same is not None:
        # a hot prefix that is a whole text: its rows are equal already, and their partial sums meet
        best = F.max(F.struct(F.coalesce("doc_id", F.lit(int(_LOWEST))).alias("doc"), "uid"))
        sums = same.groupBy("text").agg(F.sum("copies").alias("group_size"), best.alias("best"))
        sums = sums.select("text", F.col("best.uid").alias("keep_uid"), F.nullif(F.col("best.doc"), F.lit(int(_LOWEST))).alias("keep_id"), "group_size")
        groups = groups.unionByName(same.join(sums, "text").select("uid", "keep_uid", "keep_id", "group_size", "sha"))
    members = local.select(F.col("uid").alias("row_uid"), "doc_id", "rep")
    return members.join(groups, members.rep == groups.uid).select(
        "doc_id", "keep_id", "group_size", (F.col("row_uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns, whatever their names.

    It is the row of the group's largest id.  Where several rows of a group have
    that id any one of them stays.  The groups' tables and shuffle files end
    before the documents are shuffled.
    """
    columns, scratch = documents.columns, Scratch(documents.sparkSession, "exact-stay")
    sha, held, keep, of = free_names(columns, "sha", "held", "keep", "of")
    with scratch_scope():
        groups = exact_groups(documents, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        stay = scratch.put("stay", groups.groupBy(F.col("doc_id").alias(keep), F.col("text_sha256").alias(of)).agg(F.count("*").alias(held)), last=True)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    named = documents.withColumn(sha, F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), upper, upper.lower()).cast("binary"), 256))
    met = named.join(stay, (F.col(sha) == F.col(of)) & F.col(id_col).cast("long").eqNullSafe(F.col(keep)))
    often = met.where(F.col(held) > 1).dropDuplicates([keep, of])
    return met.where(F.col(held) == 1).unionByName(often).select(*(F.col(f"`{c}`") for c in columns))
