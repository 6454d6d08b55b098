"""Bounded-space online packing of token sequences into fixed windows.

A partition keeps a fixed number of open windows.  A piece goes to the open
window that it leaves fullest (best fit).  If none has room, the fullest open
window is emitted and a new one opened.  Documents longer than a window are cut
into full windows and a rest.  What is still open at the end of the partitions
is merged by the same rule over ever fewer tasks; a merge moves whole windows,
described by one slim row each.

Nulls and empty texts hold only the end id.  Repeated rows are packed once each.
An empty table gives no piece.  Only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import Scratch, task

#: Bound of a worker's memo (entries).
MEMO = 400_000
#: ASCII punctuation that may follow a word; the apostrophe has rules of its own.
_TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class OpenWindows:
    """At most ``limit`` open windows of ``size`` ids, kept sorted by the ids they hold."""

    def __init__(self, size: int, limit: int, name: Callable[[], int]):
        self.size, self.limit, self.name = size, limit, name
        self.open: list[tuple[int, int]] = []  # (filled, window)

    def place(self, n: int) -> tuple[int, int, int | None]:
        """(window, offset there, window emitted to make room) for a piece of ``n`` ids."""
        if n == self.size:  # fills a window of its own, which is never open
            return self.name(), 0, None
        i = bisect.bisect_right(self.open, (self.size - n, 1 << 62)) - 1
        gone = None
        if i >= 0:
            filled, window = self.open.pop(i)
        else:
            if len(self.open) >= self.limit:
                gone = self.open.pop()[1]
            filled, window = 0, self.name()
        if filled + n < self.size:
            bisect.insort(self.open, (filled + n, window))
        return window, filled, gone


#: The normalizer and pre-tokenizer whose rules the word encoder relies on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}


def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.encode_special_tokens = True
    return tok


class TextEncoder:
    """texts to little-endian ids by any tokenizer file, each text whole."""

    def __init__(self, spec: str):
        self.tok = _tokenizer(spec)

    def encode(self, texts: pa.Array) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]


class WordEncoder:
    """texts to little-endian ids, by their distinct words, which are looked up in a bounded memo.

    The tokenizer's own pattern never crosses white space and drops it, so a
    text's ids are the ids of its chunks between blanks.  It also ends a token
    between a letter or digit and ASCII punctuation, and lower-cases, so a chunk's
    ids are those of its lower-cased word and of its tail, provided that the
    word's last character stays a letter or digit when normalized: the tokenizer
    itself is asked once for each such character, and a chunk for which it says
    no is encoded whole.  Arrow splits a batch of texts and numbers its distinct
    chunks and words; only new words reach the tokenizer.  Words of letters alone
    are one pre-token each and are encoded many at a time: the id that ends a word
    says so.
    """

    def __init__(self, spec: str):
        self.tok = _tokenizer(spec)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parted: dict[str, bool] = {}

    @staticmethod
    def fits(spec: str) -> bool:
        """Whether the file has the rules above."""
        held = json.loads(spec)
        return held.get("normalizer") == _NORMALIZER and held.get("pre_tokenizer") == _PRE_TOKENIZER and held["model"].get("end_of_word_suffix") == "</w>"

    def _parts(self, last: str) -> bool:
        """Whether a token ends between this character and punctuation."""
        known = self.parted.get(last)
        if known is None:
            alone, both = (self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(x)) for x in (last, f"{last}!"))
            known = self.parted[last] = [t for t, _ in both] == [*(t for t, _ in alone), "!"]
        return known

    def _each(self, words: list[str]) -> None:
        for s in range(0, len(words), 10_000):
            part = words[s : s + 10_000]
            self.words.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True))

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        if len(plain) < len(words):
            self._each(list(set(words).difference(plain)))
        groups = [plain[s : s + 200] for s in range(0, len(plain), 200)]
        for g, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(g) or cut[-1] != 4 * len(ids):
                self._each(g)
                continue
            raw = ids.tobytes()
            self.words.update((w, raw[a:z]) for w, a, z in zip(g, [0, *cut], cut, strict=False))

    def _blobs(self, words: list[str]) -> list[bytes]:
        unknown = [w for w in words if w not in self.words]
        if len(self.words) + len(unknown) > MEMO:
            self.words.clear()
            unknown = words
        self._learn(unknown)
        return [self.words[w] for w in words]

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        chunks = lists.flatten().dictionary_encode()
        each, numbers = chunks.dictionary, chunks.indices.to_numpy()
        # a chunk that ends in a letter or digit and a tail is its word and its tail
        bare = pc.utf8_rtrim(each, characters=_TAIL)
        last = pc.utf8_slice_codeunits(bare, start=-1, stop=None).dictionary_encode()
        parted = pa.array([c != "" and self._parts(c) for c in last.dictionary.to_pylist()], pa.bool_())
        cut = parted.take(last.indices)
        latin = pc.and_(cut, pc.match_substring_regex(bare, r"^[\x{00}-\x{FF}]*$"))
        word = pc.if_else(latin, pc.utf8_lower(bare), pc.if_else(cut, bare, each)).dictionary_encode()
        size = np.where(cut.to_numpy(zero_copy_only=False), pc.subtract(pc.binary_length(each), pc.binary_length(bare)).to_numpy(), 0)
        tailed = np.flatnonzero(size)
        tails: dict[str, int] = {"": 0}
        tail = np.zeros(len(each), np.int64)
        tail[tailed] = [tails.setdefault(c[-k:], len(tails)) for c, k in zip(each.take(pa.array(tailed)).to_pylist(), size[tailed].tolist(), strict=True)]
        words = word.dictionary.to_pylist()
        blobs = [*self._blobs(words), *self._blobs(list(tails))]
        # ids of words and tails, then of chunks, then of texts
        ids, at = _gather(np.frombuffer(b"".join(blobs), "<u4"), np.cumsum([0, *(len(b) // 4 for b in blobs)]), np.stack([word.indices.to_numpy(), tail + len(words)], axis=1).ravel())
        ids, at = _gather(ids, at[::2], numbers)
        ends = (4 * at[lists.offsets.to_numpy()]).tolist()
        raw = ids.tobytes()
        return [raw[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def _gather(flat: np.ndarray, at: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``flat[at[i]:at[i + 1]]`` for all i of ``take`` joined, and where each begins."""
    size = np.diff(at)[take]
    begin = np.zeros(len(take) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    return flat[np.repeat(at[take] - begin[:-1], size) + np.arange(begin[-1])], begin


def text_encoder(spec: str) -> Callable[[pa.Array], list[bytes]]:
    """By distinct words where the tokenizer file has their rules, else by whole texts; the ids are the same."""
    return (WordEncoder if WordEncoder.fits(spec) else TextEncoder)(spec).encode


def _in_steps(texts: pa.Array, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.Array]:
    """Slices of at most ``rows`` texts and about ``size`` bytes."""
    ends = np.cumsum(pc.coalesce(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield texts.slice(at, stop - at)
        at = stop


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"
_PIECES_ARROW = pa.schema([(n, pa.bool_() if n == "open" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open")])


def _pack_partition(encoder: Callable, end_id: int, size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(), np.array([end_id], "<u4").tobytes()
        base, made = (TaskContext.get().partitionId() + 1) << 32, 0

        def name() -> int:
            nonlocal made
            made += 1
            return base + made

        windows, held = OpenWindows(size, limit, name), {}
        done: list[tuple] = []

        def flush(open_: bool) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[]] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([open_] * len(done))], schema=_PIECES_ARROW)
            done.clear()
            return out

        for b in batches:
            encoded = (ids for step in _in_steps(b.column(1)) for ids in encode(step))
            for doc, ids in zip(b.column(0).to_pylist(), encoded, strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    window, offset, gone = windows.place(length)
                    row = (doc, start, length, zlib.crc32(piece), n, window, offset)
                    if gone is not None:
                        done += held.pop(gone)
                    if offset + length == size:
                        done += held.pop(window, [])
                        done.append(row)
                    else:
                        held.setdefault(window, []).append(row)
                if len(done) >= 20_000:
                    yield flush(False)
        yield flush(False)
        for rows in held.values():
            done += rows
        yield flush(True)

    return run


_MOVES = "window long, target long, base long, filled long, open boolean"
_MOVES_ARROW = pa.schema([("window", pa.int64()), ("target", pa.int64()), ("base", pa.int64()), ("filled", pa.int64()), ("open", pa.bool_())])


def _merge_partition(size: int, limit: int, last: bool):
    """Place whole windows (window, filled) into windows; a target is named after its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((f, w) for b in batches for w, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), reverse=True)
        out, first = [], []
        windows = OpenWindows(size, limit if not last else max(limit, len(rows)), lambda: first[0])
        for filled, window in rows:
            first[:] = [window]
            target, base, _ = windows.place(filled)
            out.append((window, target, base, filled))
        still = {w for _, w in windows.open}
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([t in still for t in (cols[1] if out else [])], pa.bool_())], schema=_MOVES_ARROW)

    return run


def pack_tokens(documents: DataFrame, encoder: Callable, end_id: int, size: int = 4096, open_windows: int = 64, merge_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset; see the module text."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.put("pieces", rows.mapInArrow(task(_pack_partition(encoder, end_id, size, open_windows)), _PIECES))
    left = pieces.where("open").groupBy("window").agg(F.sum("length").alias("filled"))
    left = scratch.put("left-0", left)
    n = left.count()
    moves, tasks, step = None, -(-n // merge_rows), 0
    while tasks:
        # a task of the first level takes about merge_rows windows; every level has a quarter of the tasks
        dealt = left.repartition(tasks, "window") if tasks > 1 else left.coalesce(1)
        step += 1
        done = scratch.put(f"moves-{step}", dealt.select("window", "filled").mapInArrow(task(_merge_partition(size, open_windows, tasks == 1)), _MOVES))
        now = done.select("window", "target", "base")
        if moves is None:
            moves = now
        else:
            up = now.select(F.col("window").alias("target"), F.col("target").alias("target2"), F.col("base").alias("base2"))
            moves = moves.join(up, "target", "left").select("window", F.coalesce("target2", "target").alias("target"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base"))
            moves = scratch.put(f"moved-{step}", moves)
        if tasks == 1:
            break
        tasks = max(1, tasks // 4)
        left = done.where("open").groupBy(F.col("target").alias("window")).agg(F.sum("filled").alias("filled"))
        left = scratch.put(f"left-{step}", left)
    out = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    closed = pieces.where(~F.col("open")).select(*out, F.col("window").alias("sequence_id"), "offset")
    if moves is None:
        return closed
    merged = pieces.where("open").join(moves, "window").select(*out, F.col("target").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return closed.unionByName(merged)


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 2, **options) -> DataFrame:
    """``pack_tokens`` by a tokenizer file, read once on the driver (its size does not follow the corpus)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = documents.sparkSession.sparkContext.broadcast(spec)
    return pack_tokens(documents, lambda: text_encoder(shared.value), end_id, **options)
