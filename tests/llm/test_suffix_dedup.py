"""Repeated passages against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from entwine.llm import suffix_dedup as sd


def brute(texts, length, mode):
    """Per text: maximal removed runs of bytes."""
    seen = defaultdict(list)
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is not None, texts[i][0] or 0))
    raw = [(t or "").encode() for _, t in texts]
    for i in order:
        for p in range(len(raw[i]) - length + 1):
            seen[raw[i][p : p + length]].append((i, p))
    gone = [np.zeros(len(r), bool) for r in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places if mode == "all" else places[1:]:
                gone[i][p : p + length] = True
    out = []
    for r, g in zip(raw, gone, strict=True):
        kept = bytes(np.frombuffer(r, np.uint8)[~g])
        out.append((len(r), int(g.sum()), int((np.diff(np.r_[0, g.astype(int), 0]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)

    def prose(n):
        return "".join(rng.choice(list("abcdefghij é"), n))

    passages = [prose(k) for k in (70, 90, 130, 300, 64, 1000)]
    texts = []
    for i in range(60):
        parts = [prose(int(rng.integers(0, 200)))]
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, 6))]
            a = int(rng.integers(0, 10))
            parts += [p[a:], prose(int(rng.integers(0, 120)))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], texts[5] + "x", "y" + texts[5], "", None, "z" * 500, "ab" * 200, "short"]
    return list(enumerate(texts, start=10))


@pytest.mark.parametrize("mode", ["all", "later"])
@pytest.mark.parametrize("group", [256, 3])
def test_against_brute_force(spark, mode, group):
    data = corpus(1)
    df = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, row string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeated_passages(df, length=64, mode=mode, group=group).collect()}
    want = {i: w for (i, _), w in zip(data, brute(data, 64, mode), strict=True)}
    assert got == want


def test_real_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeated_passages(df).collect()}
    assert got == {i: w for (i, _), w in zip(data, brute(data, 400, "all"), strict=True)}
    assert any(w[1] for w in got.values())


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(sd, "_PIECE_BITS", 12)
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefgh"), 20_000))
    data = [(None, long), (1, long[5000:9000]), (2, "q" * 9000), (3, None), (3, None), (4, "é" * 700)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    sd._powers.clear()
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeated_passages(df).collect())
    assert got == sorted(brute(data, 400, "all"))
    same = spark.createDataFrame([(7, long), (7, long)], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in sd.repeated_passages(same).collect()] == [(20_000, 1)] * 2
    assert sd.repeated_passages(df.limit(0)).count() == 0


def test_factors():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 600).astype(np.uint8)
    order, rank = sd.suffix_order(data, np.full(600, 600), 12)
    want = defaultdict(list)
    for p in range(589):
        want[data[p : p + 12].tobytes()].append(p)
    later = {p for v in want.values() for p in v[1:]}
    assert set(order[sd.previous_factors(order, rank)].tolist()) == later
    place, run = rng.permutation(300), np.sort(rng.integers(0, 9, 300))
    near = sd.nearest_smaller(place, run)
    for i in range(300):
        best = next((j for j in range(i - 1, -1, -1) if run[j] != run[i] or place[j] < place[i]), -1)
        assert near[i] == (best if best >= 0 and run[best] == run[i] else -1)
