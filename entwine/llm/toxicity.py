"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of its parts: an embedding of the hashed word beside the
mean embedding of its hashed character n-grams, so unseen spellings share inputs
with seen ones.  Two gated recurrent layers read a window of ``WINDOW`` words in
both directions, attention pools their states and a linear unit gives the
window's logit.  All windows of a text are scored, each overlapping the next by
half; the text's score is that of its worst window.

The network is trained in numpy on the driver.  A text's training logit is the
log-sum-exp of its windows, so labels need not say where a text is toxic.
Training uses a bounded sample: at most ``sample_rows`` labelled rows a class,
in the order of a hash of the id, none over ``sample_chars`` characters, and at
most ``sample_words`` words in all.  Scores use the text alone.

A null or empty text has one empty window and gets the score of no evidence.
Rows without a label, or with a null one, do not train; repeated ones train once.  Without rows of both
labels the network stays untrained and scores everything 0.  Repeated rows get
repeated scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from entwine.llm.common import free_names, mix64, task

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN = 1 << 14, 1 << 13, 8, 12
#: Windows of one forward step, and bound of a worker's word memo.
BATCH, MEMO = 2048, 200_000
_WORDS = re.compile(r"\w+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row of each word, rows of all its three- and four-byte grams, word of each gram in order)."""
    raw = [w.encode() for w in words]
    at = np.fromiter((zlib.crc32(r) for r in raw), np.int64, len(raw)) % WORD_ROWS
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 3  # a mark before and two after
    x = np.frombuffer(b"".join(b"^%b$$" % r for r in raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    rows, owners = [], []
    for n in (3, 4):
        h = sum(x[i : len(x) - n + 1 + i] * _MULT[i] for i in range(n)) + np.uint64(n)
        inside = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool)
        rows.append((mix64(h[inside]) % np.uint64(CHAR_ROWS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    owners_ = np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return at, np.concatenate(rows)[order], owners_[order]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Network:
    """Parameters in float32; ``w`` holds them by name."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        self.w = {
            "word": n(WORD_ROWS, DIM), "char": n(CHAR_ROWS, DIM),
            "wx_f": n(2 * DIM, 3 * HIDDEN, k=0.3), "wx_b": n(2 * DIM, 3 * HIDDEN, k=0.3), "b_f": np.zeros(3 * HIDDEN, np.float32), "b_b": np.zeros(3 * HIDDEN, np.float32),
            "u_f": n(HIDDEN, 3 * HIDDEN, k=0.25), "u_b": n(HIDDEN, 3 * HIDDEN, k=0.25), "att": n(2 * HIDDEN, k=0.3), "out": n(2 * HIDDEN, k=0.3), "bias": np.full(1, -2.0, np.float32),
        }

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and the rows they came from."""
        at, flat, owner = gram_rows(words)
        size = np.bincount(owner, minlength=len(words))
        first = np.cumsum(size) - size
        chars = np.add.reduceat(self.w["char"][flat], first, axis=0) / size[:, None] if len(words) else np.zeros((0, DIM))
        return np.concatenate([self.w["word"][at], chars], axis=1).astype(np.float32), (at, flat, owner, size)

    def project(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.w[f"wx_{side}"] + self.w[f"b_{side}"]

    def run(self, proj: np.ndarray, idx: np.ndarray, side: str, tape: list | None = None) -> np.ndarray:
        """States (time, windows, hidden); ``idx`` is (time, windows) with -1 past a window's end."""
        steps = range(len(idx)) if side == "f" else range(len(idx) - 1, -1, -1)
        u, h = self.w[f"u_{side}"], np.zeros((idx.shape[1], HIDDEN), np.float32)
        out = np.empty((*idx.shape, HIDDEN), np.float32)
        for t in steps:
            g, a = proj[idx[t]], h @ u
            rz = 0.5 * (1 + np.tanh(0.5 * (g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])))
            r, z, an = rz[:, :HIDDEN], rz[:, HIDDEN:], a[:, 2 * HIDDEN :]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * an)
            new = n + z * (h - n)
            live = (idx[t] >= 0)[:, None]
            if tape is not None:
                tape.append((t, r, z, an, n, h, live))
            h = np.where(live, new, h)
            out[t] = h
        return out

    def pool(self, states: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, attention, pooled states) of the windows."""
        s = np.where(idx >= 0, states @ self.w["att"], -1e9)
        e = np.exp(s - s.max(axis=0)) * (idx >= 0)
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", alpha, states)
        return pooled @ self.w["out"] + self.w["bias"][0], alpha, pooled

    def logits(self, proj_f: np.ndarray, proj_b: np.ndarray, idx: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.run(proj_f, idx, "f"), self.run(proj_b, idx, "b")], axis=2)
        return self.pool(states, idx)[0]

    def gradients(self, words: list[str], idx: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch: ``doc`` names each window's text, ``label`` is by text."""
        x, (at, flat, owner, size) = self.inputs(words)
        tapes: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(self.project(x, s), idx, s, tapes[s]) for s in "fb"], axis=2)
        z, alpha, pooled = self.pool(states, idx)
        top = np.full(len(label), -np.inf, np.float32)
        np.maximum.at(top, doc, z)
        e = np.exp(z - top[doc])
        total = np.bincount(doc, e, len(label))
        p = 1 / (1 + np.exp(-(top + np.log(total))))
        loss = float((-weight * (label * np.log(p + 1e-9) + (1 - label) * np.log(1 - p + 1e-9))).mean())
        dz = (((p - label) * weight / len(label))[doc] * e / total[doc]).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["bias"][0], grad["out"] = dz.sum(), pooled.T @ dz
        dpool = dz[:, None] * self.w["out"]
        dalpha = np.einsum("tbh,bh->tb", states, dpool)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        grad["att"] = np.einsum("tb,tbh->h", ds, states)
        dstates = alpha[:, :, None] * dpool + ds[:, :, None] * self.w["att"]
        dx = np.zeros_like(x)
        for s, part in (("f", dstates[:, :, :HIDDEN]), ("b", dstates[:, :, HIDDEN:])):
            u, dh = self.w[f"u_{s}"], np.zeros((idx.shape[1], HIDDEN), np.float32)
            dproj = np.zeros((len(words), 3 * HIDDEN), np.float32)
            for t, r, zt, an, n, h, live in reversed(tapes[s]):
                dh = dh + part[t]
                dm = dh * live
                dn = dm * (1 - zt) * (1 - n * n)
                dr = dn * an * r * (1 - r)
                dzt = dm * (h - n) * zt * (1 - zt)
                dg, da = np.concatenate([dr, dzt, dn], axis=1), np.concatenate([dr, dzt, dn * r], axis=1)
                grad[f"u_{s}"] += h.T @ da
                ok = idx[t] >= 0
                np.add.at(dproj, idx[t][ok], dg[ok])
                dh = dm * zt + dh * ~live + da @ u.T
            grad[f"wx_{s}"], grad[f"b_{s}"] = x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ self.w[f"wx_{s}"].T
        np.add.at(grad["word"], at, dx[:, :DIM])
        np.add.at(grad["char"], flat, (dx[:, DIM:] / size[:, None])[owner])
        return loss, grad


def window_index(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((time, windows) places in the joined words or -1, text of each window); an empty text has one window."""
    count = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(doc)) - (np.cumsum(count) - count)[doc]) * STRIDE
    at = start[None, :] + np.arange(WINDOW)[:, None]
    base = np.cumsum(lengths) - lengths
    return np.where(at < lengths[doc], at + base[doc], -1), doc


def train(texts: list[str], labels: list[int], updates: int = 400, batch: int = 24, rate: float = 0.02, dropout: float = 0.3, seed: int = 11) -> Network | None:
    """Adam over shuffled batches of texts; None without both labels."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, r = Network(), np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(v) for k, v in net.w.items()}
    positive = max(1.0, float(y.sum()))
    weights = np.where(y > 0, min(4.0, (len(y) - positive) / positive), 1.0).astype(np.float32)
    order: np.ndarray = np.zeros(0, np.int64)
    for step in range(1, updates + 1):
        if len(order) < batch:
            order = np.r_[order, r.permutation(len(docs))]
        take, order = order[:batch], order[batch:]
        joined = [w for i in take for w in docs[i]]
        vocab = list(dict.fromkeys(joined)) or [""]
        number = {w: i for i, w in enumerate(vocab)}
        ids = np.array([number[w] for w in joined] + [-1], np.int64)
        idx, doc = window_index(np.array([len(docs[i]) for i in take]))
        shown = (idx >= 0) & (r.random(idx.shape) >= dropout)  # words left out in training, so no single one is relied on
        _, grad = net.gradients(vocab, np.where(shown, ids[idx], -1), doc, y[take], weights[take])
        lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / updates)
        for k, g in grad.items():
            norm = float(np.sqrt((g * g).sum()))
            g = g / max(1.0, norm)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    return net


class Scorer:
    """Scores texts by all their windows, with a bounded memo of word projections."""

    def __init__(self, net: Network | None):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.f, self.b = (np.zeros((1 << 14, 3 * HIDDEN), np.float32) for _ in "fb")

    def _learn(self, words: set[str]) -> None:
        if len(self.number) > MEMO:
            self._reset()
        new = list(words.difference(self.number))
        for s in range(0, len(new), 20_000):
            part = new[s : s + 20_000]
            x, _ = self.net.inputs(part)
            have, need = len(self.number), len(self.number) + len(part)
            if need > len(self.f):
                more = np.zeros((max(need, 2 * len(self.f)) - len(self.f), 3 * HIDDEN), np.float32)
                self.f, self.b = np.concatenate([self.f, more]), np.concatenate([self.b, more])
            self.f[have:need], self.b[have:need] = self.net.project(x, "f"), self.net.project(x, "b")
            self.number.update(zip(part, range(have, need), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        docs = [words_of(t) for t in texts]
        self._learn({w for d in docs for w in d})
        get = self.number.__getitem__
        lengths = np.array([len(d) for d in docs])
        ids = np.fromiter((i for d in docs for i in map(get, d)), np.int64, lengths.sum())
        ids = np.r_[ids, -1]
        best = np.full(len(docs), -np.inf)
        idx, doc = window_index(lengths)
        for s in range(0, len(doc), BATCH):
            part = idx[:, s : s + BATCH]
            z = self.net.logits(self.f, self.b, np.where(part >= 0, ids[part], -1))
            np.maximum.at(best, doc[s : s + BATCH], z)
        return 1 / (1 + np.exp(-best))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves remainder 0 modulo 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, sample_chars: int, sample_words: int) -> tuple[list[str], list[int]]:
    """At most ``sample_rows`` rows of either label, never a held-out one; repeated rows count once."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    order = (F.xxhash64("id"), "id", "y")
    chosen = rows.where("y = 1").orderBy(*order).limit(sample_rows).unionByName(rows.where("y = 0").orderBy(*order).limit(sample_rows))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(F.length("t") <= sample_chars)
    rank = F.row_number().over(Window.partitionBy("y").orderBy(*order[:2], "t"))
    got = texts.join(F.broadcast(chosen), "id").select("id", "t", "y").distinct().withColumn("r", rank).where(F.col("r") <= sample_rows).drop("r").collect()  # 2 * sample_rows rows at most, however often an id is repeated
    got.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["t"]))
    out, words = [], 0
    for r in got:
        words += r["t"].count(" ") + 1
        if words > sample_words:
            break
        out.append(r)
    return [r["t"] for r in out], [r["y"] for r in out]


def _scored(documents: DataFrame, labels: DataFrame, keep: list[str], name: str, id_col: str, text_col: str, label_col: str, sample_rows: int, sample_chars: int, sample_words: int) -> DataFrame:
    """Columns ``keep`` and the score under ``name``, which none of them has."""
    net = train(*training_sample(documents, labels, id_col, text_col, label_col, sample_rows, sample_chars, sample_words))
    shared = documents.sparkSession.sparkContext.broadcast(net)  # of fixed size
    (text,) = free_names([*keep, name], "text")
    src = documents.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias(text))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            out, held, size = [], [], 0
            for t in b.column(at):
                t = t.as_py() or ""
                held.append(t)
                size += len(t)
                if size > 1_000_000:
                    out.append(scorer.scores(held))
                    held, size = [], 0
            out.append(scorer.scores(held))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(at)] + [pa.array(np.concatenate(out), pa.float64())], names=[*keep, name])

    return src.mapInArrow(task(run), StructType([*src.schema.fields[:at], StructField(name, DoubleType())]))


def score_texts(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2000, sample_chars: int = 30_000, sample_words: int = 1_200_000) -> DataFrame:
    """The id, ``held_out``, ``score`` and ``predicted`` of every row; other columns are not read."""
    scored = _scored(documents, labels, [id_col], "score", id_col, text_col, label_col, sample_rows, sample_chars, sample_words)
    return scored.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2000, sample_chars: int = 30_000, sample_words: int = 1_200_000) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns, whatever their names (a column ``score`` is kept as it is)."""
    columns = documents.columns
    (score,) = free_names(columns, "score")
    scored = _scored(documents, labels, columns, score, id_col, text_col, label_col, sample_rows, sample_chars, sample_words)
    return scored.where(F.col(score) < 0.5).drop(score)
