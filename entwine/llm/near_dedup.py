"""Near duplicates by bottom-k sketches of one hash function.

A document is the set of its distinct five-word shingles (words are runs without
ASCII white space, A-Z lower-cased; a shorter text is one shingle).  Two
documents are linked if 100 * intersection >= 75 * union.

1. One scan hashes every distinct word by BLAKE2b and every shingle by one mix of
   its words' hashes, and keeps the ``K`` least (the sketch), the set size and a
   digest of the whole set.  Equal sets collapse to one node by aggregation, so
   copies never meet in one task.
2. Inverted lists: a node lists itself under its least retained values.  Values
   in over ``LIMIT`` sketches are hot; they are a table that is joined.  A node
   lists cool values only, the more of them the more of its values are hot, and
   all of them from ``SOME_HOT`` on; a node whose values are mostly hot (a member
   of a large family) also lists under hot ones.  Of lists with the same members
   one stays.
3. Within a list the union-sketch estimate selects pairs at ``MARGIN`` below the
   threshold, six standard deviations.  A list emits only who is connected, one
   row a member.
4. The candidate families are the components of that graph; no link crosses two
   of them.  Full sets are fetched for members of families only, and exact
   Jaccard verifies within the family.

Lists and families are groups that are worked on alike.  A group of over ``BLOCK``
rows or ``BLOCK_BYTES`` is first dealt in blocks, each with the group's ``PIVOTS``
pivots, at a cost linear in the group.  Then whatever is not in the group's
largest component is held against every member in pairs of blocks, so that no
pair of different components goes unseen.  No task holds a whole large group.

Chance of losing a link: a pair at the threshold shares none of its indexed
values with probability below 1e-7, and its estimate falls below the margin with
probability below 1e-7; no step samples, caps or drops rows.

Null texts and texts without words have an empty set and are linked with
nothing.  Rows with a null id are linked with nothing, have a null component and
stay.  Rows that repeat an id are one document of all their texts.  An empty
table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import Scratch, byte_view, free_names, lower_ascii, mix64, task
from entwine.llm.components import connected_components

WORDS, PERCENT = 5, 75
K = 64
#: Values listed by a node: without hot values, with some, and hot ones of a mostly hot node.
LIST_COOL, LIST_MIXED, LIST_HOT = 12, 24, 16
#: Hot values of 64 from which all cool ones are listed, and from which hot ones are.
SOME_HOT, MOSTLY_HOT = 16, 32
#: Least estimate of a candidate pair.
MARGIN = 0.425
#: Rows and bytes of a block of a list or family; pivots of a large one.
BLOCK, BLOCK_BYTES, PIVOTS = 1024, 32 << 20, 32
#: Least sketches that make a value hot.
LIMIT = 256
#: Lists of up to this many rows are estimated many at a time.
_SHORT = 64
#: Bound of a worker's memo of word hashes.
MEMO = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_memo: dict[bytes, int] = {}


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text); words are runs without ASCII white space."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    each = words.dictionary.cast(pa.large_binary()).to_pylist()
    if len(_memo) > MEMO:
        _memo.clear()
    new = [w for w in each if w not in _memo]
    _memo.update(zip(new, np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in new]), np.uint64).tolist(), strict=True))
    known = np.fromiter(map(_memo.__getitem__, each), np.uint64, len(each))
    full = np.array([len(w) > 0 for w in each], bool)  # white space at an end leaves an empty word
    at = words.indices.to_numpy()
    is_word = full[at]
    ends = np.r_[0, np.cumsum(is_word)]
    return known[at[is_word]], np.diff(ends[lists.offsets.to_numpy()])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, off = byte_view(texts)
    h, n = word_hashes(lower_ascii(data), off)
    odd = _ODD[:words] if words <= len(_ODD) else mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    ends = np.cumsum(n)
    if len(h) >= words:
        roll = h[: len(h) - words + 1] * odd[0]
        for k in range(1, words):
            roll = roll + h[k : len(h) - words + 1 + k] * odd[k]
        roll = mix64(roll)
    out = []
    for end, count in zip(ends.tolist(), n.tolist(), strict=True):
        if count >= words:
            out.append(np.unique(roll[end - count : end - words + 1]))
        elif count:
            with np.errstate(over="ignore"):
                out.append(mix64(np.array([(h[end - count : end] * odd[:count]).sum() + np.uint64(count) * np.uint64(0x9E6C63D0876A9A47)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_SKETCH = "doc_id long, n long, digest binary, sketch binary"


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                sets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()), pa.array([x[:K].tobytes() if len(x) else None for x in sets], pa.binary())],
                    names=["doc_id", "n", "digest", "sketch"],
                )

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch) to (value, node)."""
    for b in batches:
        data, off = byte_view(b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), np.diff(off) // 8))], names=["value", "node"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch, its hot values in order or null) to the lists it enters."""
    for b in batches:
        value, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, blob, hot in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            v = np.frombuffer(blob, np.int64)
            if not hot:
                chosen = v[:LIST_COOL]
            else:
                h = np.array(hot, np.int64)
                is_hot = h[np.minimum(np.searchsorted(h, v), len(h) - 1)] == v
                some, most = (len(h) * K > share * len(v) for share in (SOME_HOT, MOSTLY_HOT))
                chosen = np.concatenate([v[~is_hot][: None if some else LIST_MIXED], v[is_hot][: LIST_HOT if most else 0]])
            value.append(chosen)
            node.append(np.full(len(chosen), n, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(value)), pa.array(np.concatenate(node))], names=["value", "node"])


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches by the upper halves of their values, which keep the order."""
    for b in batches:
        upper = [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(upper, pa.binary())], names=["node", "body"])


def union_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the K least values of each union that both sketches hold; rows are sorted, padded by the maximum."""
    u = np.sort(np.concatenate([a, b], axis=1), axis=1)
    pad = u == np.iinfo(u.dtype).max
    first = np.ones(u.shape, bool)
    first[:, 1:] = u[:, 1:] != u[:, :-1]
    place = np.cumsum(first & ~pad, axis=1)
    both = (~first & ~pad & (place <= K)).sum(axis=1)
    return both / np.maximum(1, np.minimum(K, place[:, -1]))


class Forest:
    """Union-find over row numbers; the least row is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def join_equal(self, labels: list) -> None:
        first: dict = {}
        for i, x in enumerate(labels):
            self.join(first.setdefault(x, i), i)

    def stars(self) -> list[tuple[int, int]]:
        return [(self.root(i), i) for i in range(len(self.up)) if self.root(i) != i]


def _shared_counts(values: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray | None = None) -> np.ndarray:
    """Matrix of how many values rows share (rows ``left`` against all); ``values`` may be any integers."""
    uniq, inv, count = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[inv] > 1
    col, row = number[inv[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    left = np.arange(n) if left is None else left
    out = np.zeros((len(left), n), np.float32)
    width = max(64, (1 << 22) // max(1, n))
    for s in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(col, (s, s + width))
        m = np.zeros((n, width), np.float32)
        m[row[a:b], col[a:b] - s] = 1
        out += m[left] @ m.T
    return out


def _spread(adjacent: np.ndarray, forest: Forest) -> None:
    """Join rows that a symmetric matrix connects, each row visited once."""
    todo = np.ones(len(adjacent), bool)
    for i in range(len(adjacent)):
        if not todo[i]:
            continue
        front = np.array([i])
        todo[i] = False
        while front.size:
            near = np.flatnonzero(adjacent[front].any(axis=0) & todo)
            todo[near] = False
            for j in near:
                forest.join(i, int(j))
            front = near


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Runs of rows with equal leading ``keys`` columns, of sorted batches; as columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
        ends = np.r_[0, cut, b.num_rows]
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            key = tuple(x[s] for x in k)
            if key != last and held:
                yield [pa.concat_arrays([h.column(i) for h in held]) for i in range(held[0].num_columns)]
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield [pa.concat_arrays([h.column(i) for h in held]) for i in range(held[0].num_columns)]


_EDGES = "a long, b long"


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def _estimated(rows: np.ndarray, n: np.ndarray, left: np.ndarray, forest: Forest) -> None:
    """Join rows by the estimate: rows ``left`` against all, each row reached once.

    A union's least values that both sketches hold are shared values, so a count
    of these rules pairs out first.
    """
    live = np.arange(K) < n[:, None]
    counts = _shared_counts(rows[live], np.repeat(np.arange(len(n)), n), len(n), left)
    may = np.zeros((len(n), len(n)), bool)
    may[left] = counts >= MARGIN * np.maximum(n[left][:, None], n[None, :])
    may |= may.T
    todo = np.ones(len(n), bool)
    for i in range(len(n)):
        front = [i] if todo[i] else []
        todo[i] = False
        while front:
            at = front.pop()
            near = np.flatnonzero(may[at] & todo)
            near = near[union_estimate(np.broadcast_to(rows[at], (len(near), K)), rows[near]) >= MARGIN]
            todo[near] = False
            for j in near.tolist():
                forest.join(i, j)
                front.append(j)


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (family, bi, bj, part, seen, node, sketch) to who is connected by estimate in each list."""
    short: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    out: list[tuple[int, int]] = []

    def settle() -> None:
        """Estimate the pairs of many short lists at once."""
        nonlocal held
        left, right, lists = [], [], []
        for number, (nodes, _) in enumerate(short):
            i, j = np.triu_indices(len(nodes), 1)
            left.append(i)
            right.append(j)
            lists.append(np.full(len(i), number))
        base = np.cumsum([0, *(len(n) for n, _ in short)])
        which = np.concatenate(lists)
        i, j = np.concatenate(left) + base[which], np.concatenate(right) + base[which]
        rows, nodes = np.concatenate([s for _, s in short]), np.concatenate([n for n, _ in short])
        forest = Forest(len(nodes))
        for s in range(0, len(i), 20_000):
            x, y = i[s : s + 20_000], j[s : s + 20_000]
            ok = union_estimate(rows[x], rows[y]) >= MARGIN
            for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                forest.join(p, q)
        out.extend((int(nodes[p]), int(nodes[q])) for p, q in forest.stars())
        short.clear()
        held = 0

    for _, _, _, part, seen, node, sketch in _groups(batches, 3):
        part, nodes = part.to_numpy(), node.to_numpy()
        raw = sketch.to_pylist()
        n = np.array([len(x) for x in raw]) // 4
        rows = np.full((len(raw), K), np.iinfo(np.uint32).max, np.uint32)
        rows[np.arange(K) < n[:, None]] = np.frombuffer(b"".join(raw), np.uint32)
        if len(nodes) <= _SHORT and not part.any():
            short.append((nodes, rows))
            held += len(nodes) * len(nodes) // 2
            if held > 40_000:
                settle()
        else:
            forest = Forest(len(nodes))
            forest.join_equal(seen.to_pylist())
            _estimated(rows, n, np.flatnonzero(part < 2), forest)
            out.extend((int(nodes[p]), int(nodes[q])) for p, q in forest.stars() if nodes[p] != nodes[q])
        if len(out) > 20_000:
            yield _edge_batch(out)
            out.clear()
    if short:
        settle()
    yield _edge_batch(out)


def _verify(percent: int):
    """Sorted (family, bi, bj, part, seen, node, set) to verified components: rows of part 0 among themselves and against part 1.

    ``part`` 2 rows are only compared with rows of part 1; rows with one ``seen`` label are already joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, _, _, part, seen, node, sets in _groups(batches, 3):
            part, nodes = part.to_numpy(), node.to_numpy()
            rows = [np.frombuffer(x, np.uint64) for x in sets.to_pylist()]
            n = np.array([len(x) for x in rows])
            forest = Forest(len(rows))
            forest.join_equal(seen.to_pylist())
            if len(rows) <= 4:
                for i in range(len(rows)):
                    for j in range(i + 1, len(rows)):
                        if forest.root(i) != forest.root(j):
                            both = len(np.intersect1d(rows[i], rows[j], assume_unique=True))
                            if 100 * both >= percent * (n[i] + n[j] - both):
                                forest.join(i, j)
            else:
                left = np.flatnonzero(part < 2)
                both = _shared_counts(np.concatenate(rows), np.repeat(np.arange(len(rows)), n), len(rows), left)
                linked = 100 * both.astype(np.float64) >= percent * (n[left][:, None] + n[None, :] - both.astype(np.float64))
                full = np.zeros((len(rows), len(rows)), bool)
                full[left] = linked
                full |= full.T
                _spread(full, forest)
            out.extend((int(nodes[i]), int(nodes[j])) for i, j in forest.stars() if nodes[i] != nodes[j])
            if len(out) > 20_000:
                yield _edge_batch(out)
                out.clear()
        yield _edge_batch(out)

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                sets = shingle_sets(part.column(2), words)
                same = [_digest(x) == d for x, d in zip(sets, part.column(3).to_pylist(), strict=True)]
                mask = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask), pa.array([x.tobytes() for x, ok in zip(sets, same, strict=True) if ok], pa.binary())], names=["node", "family", "body"])

    return run


def _links(members: DataFrame, scratch: Scratch, name: str, check) -> DataFrame:
    """Edges that connect what ``check`` links in each group of (family, node, body); see the module text."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("family", "bi", "bj", "part", "seen", "node", "body")
    blocks = lambda rows, size: F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    large = members.groupBy("family").agg(F.count("*").alias("rows"), F.sum(F.length("body")).alias("size"))
    large = scratch.put(f"{name}-large", large.select("family", blocks(F.col("rows"), F.col("size")).alias("blocks")).where("blocks > 1"))
    sized = members.join(large, "family", "left")
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int")
    dealt = sized.select("family", own.alias("bi"), own.alias("bj"), F.lit(0).alias("part"), F.col("node").alias("seen"), "node", "body")
    if large.isEmpty():
        dealt = dealt.repartition(parts, "family").sortWithinPartitions("family", "node")
        return scratch.put(f"{name}-links", dealt.select(*order).mapInArrow(task(check), _EDGES))
    inside = scratch.put(f"{name}-inside", sized.where("blocks is not null"))
    # pivots: the PIVOTS least hashes of a large group, kept by partial aggregation
    least = [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)]
    pivots = inside.groupBy("family").agg(F.array_distinct(F.array(*least)).alias("pivots")).select("family", F.explode("pivots").alias("node"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bi")
    shared = inside.join(pivots, ["family", "node"]).select("family", every, "node", "body")
    shared = shared.select("family", "bi", F.col("bi").alias("bj"), F.lit(1).alias("part"), F.col("node").alias("seen"), "node", "body")
    dealt = dealt.unionByName(shared).repartition(parts, "family", "bi").sortWithinPartitions("family", "bi", "bj", "node")
    first = scratch.put(f"{name}-links", dealt.select(*order).mapInArrow(task(check), _EDGES))
    # what the blocks and pivots left apart, against everything of its group
    known = connected_components(first, scratch, f"{name}-known")
    inside = inside.join(known, "node", "left").select("family", "node", "body", F.coalesce("label", "node").alias("seen"))
    weight = inside.groupBy("family", "seen").agg(F.count("*").alias("w"), F.sum(F.length("body")).alias("size"))
    main = weight.groupBy("family").agg(F.max_by("seen", F.struct("w", "seen")).alias("main"), F.sum("w").alias("rows"), F.sum("size").alias("size"))
    left = weight.join(main.select("family", "main"), "family").where("seen <> main").groupBy("family").agg(F.sum("w").alias("rest"), F.sum("size").alias("rest_size"))
    plan = left.join(main, "family").select("family", "main", blocks(F.col("rest"), F.col("rest_size")).alias("m"), blocks(F.col("rows"), F.col("size")).alias("k"))
    plan = scratch.put(f"{name}-plan", plan)
    again = inside.join(plan, "family")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rest = again.where("seen <> main").select("family", place("m").alias("bi"), number("k").alias("bj"), F.lit(1).alias("part"), "seen", "node", "body")
    all_ = again.select("family", number("m").alias("bi"), place("k").alias("bj"), F.lit(2).alias("part"), "seen", "node", "body")
    dealt = rest.unionByName(all_).repartition(parts, "family", "bi", "bj").sortWithinPartitions("family", "bi", "bj", "node")
    second = scratch.put(f"{name}-more", dealt.select(*order).mapInArrow(task(check), _EDGES))
    scratch.drop(f"{name}-inside")
    return first.unionByName(second)


def near_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    scratch = Scratch(documents.sparkSession, "near-dedup")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = scratch.put("sketches", rows.mapInArrow(task(_sketches(words)), _SKETCH))
    named = docs.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    nodes = scratch.put("nodes", named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")))
    values = nodes.select("node", "sketch").mapInArrow(task(_values), "value long, node long")
    hot = scratch.put("hot", values.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("value"))
    marked = values.join(hot.select("value", F.lit(True).alias("is_hot")), "value", "left")
    of = marked.groupBy("node").agg(F.array_sort(F.collect_list(F.when(F.col("is_hot"), F.col("value")))).alias("hot"))  # at most K a node
    listed = nodes.join(of, "node", "left").select("node", "sketch", "hot").mapInArrow(task(_postings), "value long, node long")
    listed = scratch.put("postings", listed)
    lists = listed.groupBy("value").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("size > 1")
    lists = scratch.put("lists", lists.groupBy("size", "x", "y").agg(F.min("value").alias("value")).select("value"))
    members = listed.join(lists, "value").withColumnRenamed("value", "family")
    members = members.join(nodes.select("node", "sketch").mapInArrow(task(_narrow), "node long, body binary"), "node").select("family", "node", "body")
    near = _links(scratch.put("members", members), scratch, "near", _connect)
    families = scratch.put("families", connected_components(near, scratch, "near"))
    scratch.drop("postings", "lists", "members")
    wanted = nodes.select("node", "digest").join(families, "node").select("node", F.col("label").alias("family"), "digest")
    texts = rows.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id").select(F.col("doc_id").alias("node"), "family", "text", "digest")
    sets = scratch.put("sets", texts.mapInArrow(task(_full_sets(words)), "node long, family long, body binary"))
    labels = connected_components(_links(sets, scratch, "exact", _verify(percent)), scratch, "linked")
    named_nodes = scratch.put("named", nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component")))
    scratch.drop("sets")
    out = docs.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("of")).join(named_nodes, F.col("of") == F.col("digest"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that are the least id of their component, or have no id, with all their columns, whatever their names."""
    (gone_id,) = free_names(documents.columns, "gone")
    gone = near_components(documents, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id))
    return documents.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
