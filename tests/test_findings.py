"""What a reviewer found, on small tables that showed it."""

import pytest
from pyspark.sql import functions as F

from entwine.llm import exact_dedup
from entwine.operators import blocking, sampling
from entwine.plans import catalogue, linkage
from tests.sqlcheck import agrees, connect


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables by name: (rows, columns); the folder and a connection that sees them."""

    def write(**named):
        for name, (rows, columns) in named.items():
            spark.createDataFrame(rows, columns).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
        con = connect("/root/testdata/sf0.001")
        for name in named:
            con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), con

    return write


CUSTOMERS, ORDERS = "c_custkey long, c_mktsegment string", "o_orderkey long, o_custkey long"


def test_split_sizes_are_decimals(spark):
    df = spark.createDataFrame([(i, "US", 0) for i in range(90)], "s long, country string, n_matches int")
    assert sampling.assign_splits(df).where("split = 'A_train'").count() == 32  # 31.5, to the even number


@pytest.mark.parametrize("customers", [[(i, "a") for i in range(90)], [(i % 40, None if i % 4 == 0 else "b") for i in range(170)] + [(None, "b")]], ids=["halves", "repeated rows, nulls"])
def test_splits_against_sql(spark, tables, customers):
    orders = [(i if i % 5 else None, i * i % 37) for i in range(60)]
    d, con = tables(customer=(customers, CUSTOMERS), orders=(orders, ORDERS))
    assert not agrees(catalogue.assign_splits(spark, d), con, catalogue.ORACLES["assign_splits"])


def test_only_rows_below_a_hot_prefix_meet_the_next_level(spark):
    """One family of long texts makes six levels; the other rows are joined at the first alone."""
    import re

    family = ["h" * 9000 + str(i) for i in range(8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(family + [f"text {i:04} of its own" for i in range(500)])], "doc_id long, text string")
    scratch = exact_dedup.Scratch(spark, "test")
    reps = scratch.put("reps", df.selectExpr("doc_id as uid", "doc_id", "1L as copies", "cast(text as binary) as text", "'' as sha"))
    levels = exact_dedup.hot_prefixes(reps, scratch, 30_000)
    dealt, whole = exact_dedup._dealt(reps, levels, scratch)
    assert len(levels) == 6 and dealt.count() + whole.count() == 508
    assert [scratch.get(f"below-{i}", reps).count() for i in range(6)] == [8] * 6
    assert not re.search("LeftOuter", dealt._jdf.queryExecution().toString())


def test_hot_prefixes_write_no_text_again(spark, tmp_path, monkeypatch):
    """Sixty copies of long texts in tasks of their own: levels hold places alone, and the groups' tables end before the rows are dealt."""
    import os

    rows = [(i * 100 + k, f"{i} common start {chr(97 + i) * 3000}") for i in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    scratch = exact_dedup.Scratch(spark, "test")
    reps = df.selectExpr("doc_id as uid", "doc_id", "1L as copies", "cast(text as binary) as text", "'' as sha")
    levels = exact_dedup.hot_prefixes(reps, scratch, 10_000)
    assert len(levels) == 6 and all("text" not in spark.read.parquet(scratch.path(f"below-{i}")).columns for i in range(6))
    dealt, whole = exact_dedup._dealt(reps, levels, scratch)
    assert not dealt.count() and whole.count() == 240
    monkeypatch.setattr("entwine.scratch.scratch_root", lambda _: str(tmp_path))
    out = exact_dedup.drop_exact_copies(df)
    assert [d.split("-")[:2] for d in os.listdir(tmp_path)] == [["exact", "stay"]]
    assert sorted(r.doc_id for r in out.collect()) == [i * 100 + 59 for i in range(4)]


PARTS = [(i, f"brand{i % 2}", ["red ring", "red bolt", "old plate", "hot ring", "blue nut"][i * i % 7 % 5], ["SMALL", "LARGE"][i % 3 % 2], i % 11) for i in range(240)]


@pytest.mark.parametrize("name", ["tfidf_weights", "tfidf_topk", "tfidf_topk_grouped", "idf_jaccard"])
def test_equal_parts_against_sql(spark, tables, name):
    d, con = tables(part=(PARTS, "p_partkey long, p_brand string, p_name string, p_type string, p_size int"))
    assert not agrees(catalogue.QUERIES[name](spark, d), con, catalogue.ORACLES[name])


def test_equal_texts_are_weighed_once(spark):
    docs = spark.createDataFrame([(i, "b", t) for i, t in enumerate(["red ring", "red bolt", "old plate"] * 200)], "id long, block string, txt string")
    members, classes = blocking.text_classes(docs)
    assert members.count() == 600 and sorted(map(tuple, classes.select("id", "copies").collect())) == [(0, 200), (1, 200), (2, 200)]
    grams = blocking.char_ngrams(F.col("txt"))
    one, all_ = blocking.term_weights(classes, grams, "block", 2, 0.9, "copies"), blocking.term_weights(docs, grams, "block", 2, 0.9)
    assert one.count() * 200 == all_.count()
    assert {(r.term, round(r.w, 9)) for r in one.collect()} == {(r.term, round(r.w, 9)) for r in all_.collect()}


def test_equal_names_are_compared_once(spark, monkeypatch):
    """Lists of a few ids, so that a name and cell has several, against the pairs one by one."""
    rows = spark.createDataFrame([(i, "AB"[i % 2], i % 3, f"{['red', 'old', 'hot'][i * i % 5 % 3]} {['ring', 'bolt'][i % 7 % 2]}") for i in range(150)], "id long, country string, cell int, name string")
    idf = linkage.idf_table(rows.select(rows.id.alias("entity_id"), "country", rows.name.alias("name_core")))
    side = lambda k: rows.select(rows.id.alias(k), "country", "cell", rows.name.alias(f"{k}_name"))
    plain, compared = linkage.idf_overlap, []
    monkeypatch.setattr(linkage, "idf_overlap", lambda p, i: compared.append(p.count()) or plain(p, i))
    key = lambda df: sorted((r.s, r.c, round(r.name_idf_jacc, 9), round(r.name_rare_mismatch, 9)) for r in df.collect())
    got = key(linkage.idf_overlap_within(rows, "cell", idf, size=4))
    assert got == key(plain(side("s").join(side("c"), ["country", "cell"]).where("s < c"), idf)) and len(got) == 1800
    assert compared[0] <= 42


def test_orphan_counts_walk_wanted_pairs_only(spark):
    """Against plain counts; no join of all neighbours of all pairs to the wanted ones."""
    import re

    from entwine.operators import windows

    scored = {(i % 7, i * i % 11): (i * 13 % 20) / 20 for i in range(60)}
    links = {(a, b) for a in range(13) for b in range(13) if a != b and (a * b + a + b) % 4 == 0}
    df = spark.createDataFrame([(s, c, p) for (s, c), p in scored.items()], "s long, c long, p double")
    out = windows.orphan_features(df, spark.createDataFrame(sorted(links), "a long, b long"))
    best = {c: max(p for (_, y), p in scored.items() if y == c) for _, c in scored}
    want = {}
    for s, c in scored:
        near = [b for a, b in links if a == c]
        mine = [scored.get((s, b), 0) >= 0.5 for b in near]
        if near:
            want[s, c] = (len(near), sum(mine), sum(best.get(b, 0) < 0.1 for b in near), sum(best.get(b, 0) >= 0.5 and not m for b, m in zip(near, mine, strict=True)))
    assert {(r.s, r.c): (r.n_nb, r.n_same, r.n_orphan, r.n_owned) for r in out.collect()} == want
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert not any(re.search(r"\(s#.*\(b#", x) for x in joins)


def test_training_sample_is_bounded_with_repeated_ids(spark):
    """Thirty copies of every document and label, under their own ids."""
    from entwine.llm import toxicity

    ids = [i for i in range(100) for _ in range(30)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    texts, y = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 20, 1000, 100_000)
    assert len(texts) == len(set(texts)) == 40 and sum(y) == 20
    once = toxicity.training_sample(docs.distinct(), labels.distinct(), "doc_id", "text", "toxic", 20, 1000, 100_000)
    assert once == (texts, y)


def test_string_measures_of_many_pairs_at_once():
    """Against the plain ones, in blocks of pairs of like length; long and empty strings too."""
    import random

    from entwine.functions import similarity as sim

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n)).strip()
    left, right = ([word(r.choice((0, 1, 3, 9, 20, 63, 64, 90))) for _ in range(1500)] for _ in "lr")
    left += ["martha", "dixon", "jellyfish", "same"]
    right += ["marhta", "dicksonx", "smellyfish", "same"]
    for many, one in ((sim.ratios, sim.ratio), (sim.partial_ratios, sim.partial_ratio), (sim.jaro_winklers, sim.jaro_winkler), (sim.token_sort_ratios, sim.token_sort_ratio), (sim.token_set_ratios, sim.token_set_ratio)):
        assert [round(x, 9) for x in many(left, right)] == [round(one(a, b), 9) for a, b in zip(left, right, strict=True)], one.__name__
        assert not len(many([], []))


def test_pair_features_read_written_steps(spark, sf):
    """The text rules of the records stand in no later plan; planning them again and again was what took the time."""
    from entwine.plans import catalogue as c

    out = c.pair_features_48(spark, sf)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 300_000
    assert out.count() and len(out.columns) == 50


def test_bucketed_search_makes_no_pairs_of_buckets(spark):
    """Vectors that point everywhere, a third of them the same: nearly all of the exact list, ties by id, and no join by bucket."""
    import numpy as np

    from entwine.operators.windows import top_n

    r = np.random.default_rng(3)
    v = r.standard_normal((600, 16))
    v[::3] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "id long, v array<double>, block int").repartition(5)
    out = blocking.dense_topk_lsh(df.where("id % 20 = 0"), df, 10, rows=64)
    assert not [x for x in ("BroadcastHashJoin", "SortMergeJoin", "Generate") if x in out._jdf.queryExecution().executedPlan().toString()]
    got = {(x.s, x.c): x.dense_rank for x in out.collect()}
    exact = blocking.dense_topk(df.where("id % 20 = 0"), df, 1000).withColumn("dense_sim", F.round("dense_sim", 9)).drop("dense_rank")
    want = {(x.s, x.c) for x in top_n(exact, "s", "dense_sim", "c", 10).collect()}
    assert len(got) <= 300 and len(want & set(got)) >= 0.9 * len(want)
    assert sorted(c for s, c in got if s == 0) == [3 * i for i in range(1, 11)]


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"


def test_duplicate_support_against_sql(spark, tables):
    """Pairs of parts that share many orders, a supplier with most claims, nulls in every key."""
    lines = [(i * i % 61, i * 7 % 23 if i % 3 else i % 4, 0 if i % 2 else i % 5, float(i * 13 % 50)) for i in range(500)]
    lines += [(None, 1, 1, 40.0), (3, None, 1, 41.0), (3, None, 2, 90.0), (4, 2, None, 60.0), (4, 3, None, 60.0), (5, 6, 1, None)]
    d, con = tables(lineitem=(lines, LINES))
    assert not agrees(catalogue.duplicate_support(spark, d), con, catalogue.ORACLES["duplicate_support"])


@pytest.mark.parametrize("limits", [{}, {"chunk_rows": 25, "block_edges": 20, "steps": 7}], ids=["one block", "many blocks, an entity beyond a chunk"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_support_walks_no_rows_over_a_shuffle(spark, kind, limits):
    """Against plain sums; chunks of entities meet blocks of edges, only an entity beyond a chunk is joined."""
    from entwine.operators import windows

    name = (lambda x: f"k{x}") if kind == "string" else int
    scored = {(0 if i % 4 == 0 else i % 9, i * i % 43): (i * 13 % 20) / 20 for i in range(160)}
    links = {(a, b) for a in range(47) for b in range(47) if a != b and (a * b + a + b) % 4 == 0}
    df = spark.createDataFrame([(name(s), name(c), p) for (s, c), p in scored.items()], f"s {kind}, c {kind}, p double").repartition(3)
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in sorted(links)] * 2, f"a {kind}, b {kind}")
    out = windows.second_stage_features(df, edges, **limits)
    got = {(r.s, r.c): (r.sup_max, round(r.sup_mean, 9), r.sup_deg, r.sup_n70, round(r.sup_p, 9)) for r in out.collect()}
    want = {}
    for (s, c), p in scored.items():
        q = [x for (t, a), x in scored.items() if t == s and x >= 0.3 and (a, c) in links]
        want[name(s), name(c)] = (max(q, default=0), round(sum(q) / max(1, len(q)), 9), len(q), sum(x >= 0.7 for x in q), round(max(q, default=0) * p, 9))
    assert got == want and out.count() == len(scored)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join Inner" in plan) == (max(sum(t == s for t, _ in scored) for s in range(9)) > limits.get("chunk_rows", 1 << 20))


def test_equal_vectors_are_compared_once(spark):
    """Lists of equal vectors longer than k, against the pairs one by one; the join is of seven by three vectors a block."""
    v = lambda i: [1.0 if j == i else i / 10 for j in range(3)]
    q = spark.createDataFrame([(i, v(i % 7), "AB"[i // 7 % 2]) for i in range(56)], "id long, v array<double>, block string")
    p = spark.createDataFrame([(100 + i, v(i % 3), "AB"[i // 3 % 2]) for i in range(36)], "id long, v array<double>, block string")
    got = {(r.s, r.c, round(r.dense_sim, 9), r.dense_rank) for r in blocking.dense_class_topk(q, p, 8).collect()}
    assert got == {(r.s, r.c, round(r.dense_sim, 9), r.dense_rank) for r in blocking.dense_topk(q, p, 8).collect()} and len(got) == 448


def test_equal_records_are_compared_once(spark, monkeypatch):
    """Ten copies of six records of either side: 3600 pairs, 36 of them of different texts."""
    text = ("name_norm", "name_skeleton", "name_phonetic", "legal_suffix", "addr_norm", "addr_core", "addr_raw", "name_raw", "house_no", "num_tokens", "unit", "state")
    rows = [(f"{side}{i}", int(side), "US", "", f"red ring {i % 6}", *(f"{i % 6} {c}" for c in text)) for side in "12" for i in range(60)]
    records = spark.createDataFrame(rows, ", ".join(["entity_id string, source byte, country string, name_domain string, name_core string", *(f"{c} string" for c in text)]))
    side = lambda k, n: records.where(f"source = {n}").select(records.entity_id.alias(k))
    compared, plain = [], linkage.idf_overlap
    monkeypatch.setattr(linkage, "idf_overlap", lambda p, i: compared.append(p.count()) or plain(p, i))
    out = linkage.pair_features(side("s", 1).crossJoin(side("c", 2)), records)
    assert compared == [36] and out.count() == 3600
    assert {r.name_ratio == 100 for r in out.where("substr(s, 2) = substr(c, 2)").collect()} == {True}
