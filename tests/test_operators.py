"""Operators on small fixtures and against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from entwine import config
from entwine.functions import similarity as sim
from entwine.operators import blocking, decision, models, noise, sampling, windows
from entwine.plans import linkage
from entwine.sources import tables


def pairs(spark, rows, cols="s string, c string"):
    return spark.createDataFrame(rows, cols)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


# similarity


def test_metrics():
    assert sim.ratio("", "") == 100 and sim.ratio("abcd", "abxd") == 75
    assert sim.token_sort_ratio("b a", "a b") == 100
    assert sim.token_set_ratio("a b", "a b c") == 100 and sim.token_set_ratio("", "a") == 0
    assert sim.partial_ratio("abc", "xxabcxx") == 100
    assert round(sim.jaro_winkler("martha", "marhta"), 4) == 0.9611 and sim.jaro_winkler("", "a") == 0
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert sim.common_subsequence(a, b) == t[-1][-1]
    assert sim.idf_coverage(["rare", "inc"], ["raree"], {"rare": 9.0, "inc": 1.0}) == (0.9, True)


# sources


def test_family_and_truth(spark, tmp_path):
    for k, text in ((1, 'S1-1\tA "quoted" & Co\t1 Main St, X, TX\tUS\nS1-2\tB\t\tUS\n'), (2, "S2-1\tA Co\t1 MAIN ST\tUS\n"), (3, "S3-1\tB\t2 Rd\tUS\n")):
        (tmp_path / f"train_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + text)
    rows = sorted(tables.read_family(spark, str(tmp_path), "train").collect(), key=lambda r: r.entity_id)
    assert [r.source for r in rows] == [1, 1, 2, 3]
    assert rows[0].business_name == 'A "quoted" & Co' and rows[1].business_address == ""
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    lists = tables.read_lists(spark, str(tmp_path / "truth.tsv"))
    assert {r.s: r.ids for r in lists.collect()} == {"S1-1": ["S2-1", "S3-1"], "S1-2": []}
    assert got(tables.list_pairs(lists)) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]


def test_submission(spark, tmp_path):
    ents = spark.createDataFrame([("S1-1", 0), ("S1-2", 1), ("S1-3", 2)], "s string, pos int")
    pred = pairs(spark, [("S1-1", "S3-1"), ("S1-1", "S2-9"), ("S1-3", "S2-7")])
    cand = pairs(spark, [("S1-1", "S2-9"), ("S1-1", "S3-1"), ("S1-1", "S2-4"), ("S1-2", "S2-5")])
    m, c = tables.submission(ents, pred, cand)
    assert [r[1] for r in m.collect()] == ["S2-9,S3-1", "", ""]
    assert [r[1] for r in c.collect()] == ["S2-4,S2-9,S3-1", "S2-5", ""]
    assert tables.check_submission(m, c, ents) == []
    assert tables.check_submission(c, m, ents) == ["a match is no candidate"]
    tables.write_tsv(m, str(tmp_path / "m"))
    back = tables.read_lists(spark, str(tmp_path / "m"))
    assert {r.s: r.ids for r in back.collect()}["S1-1"] == ["S2-9", "S3-1"]
    lists, cands = tables.splice(pairs(spark, [("a", "x")]), pairs(spark, [("a", "x")]), pairs(spark, [("b", "x"), ("b", "y")]))
    assert got(lists) == [("a", "x"), ("b", "y")] == got(cands)
    tables.log_metrics(str(tmp_path / "j"), "a", {"x": 1})
    tables.log_metrics(str(tmp_path / "j"), "b", {"y": 2})
    assert '"y": 2' in (tmp_path / "j").read_text() and '"x": 1' in (tmp_path / "j").read_text()
    assert tables.markdown(pairs(spark, [("a", "b")])).splitlines()[2] == "| a | b |"


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nb: 3\n")
    (tmp_path / "own.yaml").write_text("base: base.yaml\na: {y: 5}\n")
    assert config.load_config(tmp_path / "own.yaml") == {"a": {"x": 1, "y": 5}, "b": 3}


# windows


CLAIMS = [("s1", "x", 0.9), ("s2", "x", 0.7), ("s3", "x", None), ("s1", "y", 0.4), ("s2", "y", 0.4), ("s1", "z", 0.2)]


def test_competition(spark):
    df = pairs(spark, CLAIMS, "s string, c string, p double")
    t = windows.competition_table(df, "p")
    want = [("s1", "x", 1, 0.2, 2), ("s1", "y", 1, 0.0, 2), ("s1", "z", 1, None, 1), ("s2", "x", 2, -0.2, 2), ("s2", "y", 2, 0.0, 2)]
    assert [(a, b, r, None if m is None else round(m, 6), n) for a, b, r, m, n in got(t)] == want
    look = {(r.s, r.c): (r.crank, r.ncomp) for r in windows.competition_lookup(df.select("s", "c"), t).collect()}
    assert look["s3", "x"] == (99, 0)
    multi = {(r.s, r.c): (r.a_crank, r.a_ncomp) for r in windows.competition_signals(df, {"a_": "p"}).collect()}
    assert multi["s3", "x"] == (99, 0) and multi["s2", "x"] == (2, 2)
    hidden = windows.hidden_competition(df, pairs(spark, [("s1",)], "s string"), "p")
    assert {(r.s, r.c): r.crank for r in hidden.collect()} == {("s2", "x"): 1, ("s2", "y"): 1}
    assert got(df.where("c = 'y'").select("s", windows.second_max("p", "c"))) == [("s1", 0.4), ("s2", 0.4)]


def test_duplicate_support(spark):
    scored = pairs(spark, [("a", "x", 0.95), ("a", "y", 0.2), ("a", "z", 0.1), ("b", "y", 0.4)], "s string, c string, p double")
    t = {(r.s, r.c): r for r in windows.second_stage_features(scored, pairs(spark, [("x", "y"), ("y", "x")], "a string, b string")).collect()}
    assert t["a", "y"].sup_max == 0.95 and t["a", "z"].sup_max == 0 and t["b", "y"].sup_max == 0
    assert t["a", "x"].rank_p == 1 and round(t["a", "y"].p_gap, 6) == 0.75 and t["a", "y"].sup_n70 == 1


def test_other_windows(spark):
    df = pairs(spark, [("s", "a", 0.95, 1.0), ("s", "b", 0.92, 3.0), ("s", "c", 0.3, None)], "s string, c string, p double, rr double")
    t = {r.c: r for r in windows.stack_features(df).collect()}
    assert (t["c"].rr_rank, t["c"].rr_gap, t["b"].rr_rank, t["a"].p_rank) == (99, None, 1, 1)
    t = {r.c: r for r in windows.cluster_support(df, F.abs(F.col("l.p") - F.col("r.p"))).collect()}
    assert t["c"].s1_nconf == 2 and t["a"].s1_nconf == 1 and round(t["c"].sib_max, 2) == 0.65
    t = {r.c: r for r in windows.model_competition(df).collect()}
    assert t["a"].a_share == 1.0 and t["a"].a_nhi == 0
    v = pairs(spark, [("a", [1.0, 0.0]), ("c", [0.6, 0.8])], "c string, v array<double>")
    assert [(r.c, round(r.emb_max, 6)) for r in windows.embedding_support(df, v).collect()] == [("c", 0.6)]
    s = spark.createDataFrame([("s", "US", "n", "1 a")], "id string, country string, name string, address string")
    c = spark.createDataFrame([("a", "US", "n", ""), ("b", "US", "m", "1 a")], "id string, country string, name string, address string")
    t = {r.c: r for r in windows.name_counts(df.where("c <> 'c'").select("s", "c"), s, c).collect()}
    assert (t["a"].cand_noaddr, t["a"].name_exact, t["b"].name_exact) == (1, 1, 0)
    t = {r.c: r for r in windows.address_counts(df.where("c <> 'c'").select("s", "c"), s, c).collect()}
    assert (t["a"].cand_addr_s1cnt, t["b"].cand_addr_s1cnt, t["b"].s1_addr_cnt) == (0, 1, 1)
    e = pairs(spark, [("a", "b"), ("a", "q")], "a string, b string")
    assert got(windows.orphan_features(df, e).select("c", "n_nb", "n_same", "n_orphan", "n_owned")) == [("a", 2, 1, 1, 0)]


# decision


def test_decide_and_evaluate(spark):
    scored = pairs(spark, [("a", "x", 0.9), ("b", "x", 0.8), ("b", "y", 0.95), ("c", "z", 0.3)], "s string, c string, p double")
    pred = decision.decide(scored, 0.5)
    assert got(pred.select("s", "c")) == [("a", "x"), ("b", "y")]
    truth = pairs(spark, [("a", "x"), ("b", "y"), ("b", "w")])
    ents = pairs(spark, [("a", "US"), ("b", "US"), ("c", "FR")], "s string, country string")
    r = decision.evaluate(pred, truth, ents).first()
    b = 1.25 * 0.5 / (0.25 + 0.5)
    assert r.singletons == 1.0 and math.isclose(r.non_singletons, (1 + b) / 2) and math.isclose(r.macro_f05, (2 + b) / 3)
    assert {x.country: x.n for x in decision.f05_breakdown(pred, truth, ents, "country").collect()} == {"US": 2, "FR": 1}
    assert math.isclose(decision.pair_completeness(pred, truth).first()[0], 2 / 3)
    assert decision.pair_completeness(pred, truth.limit(0)).first()[0] == 1.0
    assert decision.candidates_per_entity(scored, ents).first()["max"] == 2
    grid = decision.threshold_grid(scored, truth, ents, [0.1, 0.5, 0.92])
    plain = {t: decision.macro_f05(decision.decide(scored, t), truth, ents).first()[0] for t in (0.1, 0.5, 0.92)}
    assert {r.tau: round(r.macro_f05, 9) for r in grid.collect()} == {t: round(v, 9) for t, v in plain.items()}
    assert decision.best_threshold(grid) == max(plain, key=lambda t: (plain[t], -t))
    assert decision.oracle_f05(scored, truth, ents).first()[0] >= decision.macro_f05(pred, truth, ents).first()[0]
    w = decision.what_if(pred, truth, ents).first()
    assert w.perfect == 1.0 and w.as_is <= w.no_missed
    assert decision.rescale_by_country(scored.join(ents, "s"), {"FR": 0.2}, 0.5).where("s = 'c'").first().p == pytest.approx(0.75)


@pytest.mark.parametrize("pred, true, want", [((47, 193, 812), (47, 812), 0.7142857), ((), (), 1.0), ((1,), (), 0.0), ((), (1,), 0.0), ((1,), (2,), 0.0)])
def test_f05(spark, pred, true, want):
    df = lambda xs: spark.createDataFrame([("s", x) for x in xs], "s string, c int")
    assert math.isclose(decision.macro_f05(df(pred), df(true), pairs(spark, [("s",)], "s string")).first()[0], want, rel_tol=1e-6)


def test_expected_decisions(spark):
    t = pairs(spark, [("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", 0.05), ("b", "x", 0.1)], "s string, c string, q double")
    assert got(decision.decide_expected(t).select("s", "c")) == [("a", "x"), ("a", "y")]
    sim_ = {r.s: r.k for r in decision.expected_f_simulated(t).collect()}
    assert sim_ == {"a": 2, "b": 0}


def test_auc_and_friends(spark):
    r = random.Random(2)
    data = [(round(r.random(), 1), r.randrange(2)) for _ in range(200)]
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(data, "p double, label int")
    assert math.isclose(decision.auc(df).first()[0], want)
    assert decision.psi(df, df, "p").first()[0] < 1e-9 < decision.psi(df, df.withColumn("p", F.col("p") / 2), "p").first()[0]
    lo, hi = decision.bootstrap_interval(df, "p", draws=200)
    assert lo < sum(p for p, _ in data) / 200 < hi
    assert math.isclose(spark.range(1).select(decision.label_shift_tau(F.lit(0.5), F.lit(0.5))).first()[0], 0.75)
    assert math.isclose(decision.implied_score(0.9, {"a": 0.5, "b": 0.5}, {"a": 1.0}, "b"), 0.8)
    grid = spark.createDataFrame([(0, 0.1, 5.0), (1, 0.1, 1.0), (0, 0.2, 1.0), (1, 0.2, 2.0)], "fold int, tau double, score double")
    assert got(decision.nested_thresholds(grid)) == [(0, 0.2, 1.0), (1, 0.1, 1.0)]


# blocking


def test_tfidf_is_the_textbook_formula(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "de", "a"]) + str(r.randrange(3)) for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, t string")
    w = blocking.term_weights(df, blocking.char_ngrams(F.col("t")), min_df=2, max_df=0.5)

    def grams(t):
        out = []
        for word in t.split():
            p = f" {word} "
            for n in (3, 4, 5):
                out += [p[i : i + n] for i in range(max(1, len(p) - n + 1))]
                if len(p) <= n:
                    break
        return Counter(out)

    tf = {i: grams(t) for i, t in docs}
    n, dfs = len(docs), Counter(g for c in tf.values() for g in c)
    for i, c in tf.items():
        raw = {g: (1 + math.log(k)) * (math.log((1 + n) / (1 + dfs[g])) + 1) for g, k in c.items() if 2 <= dfs[g] <= n / 2}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        tf[i] = {g: x / norm for g, x in raw.items()}
    have = defaultdict(dict)
    for r_ in w.collect():
        have[r_.id][r_.term] = r_.w
    for i in tf:
        assert have[i].keys() == tf[i].keys() and all(abs(have[i][g] - x) < 1e-9 for g, x in tf[i].items())
    top = blocking.tfidf_topk(w, df.where("id < 10").select("id"), 3, 0.1)
    best = max(range(10, 60), key=lambda j: (round(sum(x * tf[j].get(g, 0) for g, x in tf[0].items()), 9), -j))
    assert top.where("s = 0 and tfidf_rank = 1").first().c == best


def test_groups_see_their_own_and_the_unknown(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "x")], "id long, t string")
    g = spark.createDataFrame([(0, "texas"), (1, "texas"), (2, "ohio"), (3, "")], "id long, grp string")
    w = blocking.term_weights(df, F.split("t", " "))
    assert {r.c for r in blocking.tfidf_topk(w, df.where("id = 0").select("id"), 9, 0.1, g).collect()} == {1, 3}


def test_merge_groups(spark):
    rows = [("delhi", "uttar pradesh")] * 100 + [("delhi", "delhi")] * 100 + [("kerala", "delhi")] * 2
    merged = blocking.merge_groups(blocking.cross_group_counts(spark.createDataFrame(rows, "gs string, gc string")), 0.002, 100)
    assert merged == {"delhi": "delhi+uttar pradesh", "uttar pradesh": "delhi+uttar pradesh"}


def test_blocks_and_channels(spark):
    toks = spark.createDataFrame([(1, "acme"), (1, "common"), (1, "12"), (2, "acme"), (2, "common"), (3, "common"), (1, "ab")], "id long, tok string")
    assert got(blocking.rarest_tokens(toks, 1).select("id", "tok")) == [(1, "acme"), (2, "acme"), (3, "common")]
    keys = spark.createDataFrame([(1, True, "k"), (2, False, "k"), (3, False, "k"), (3, False, "j"), (1, True, "j")], "id long, is_query boolean, key string")
    assert got(blocking.block_pairs(keys, 10)) == [(1, 2, 1), (1, 3, 2)]
    assert got(blocking.block_pairs(keys, 2)) == [(1, 3, 1)]
    rec = spark.createDataFrame([(1, True, "acme bakery", "12 main", "12"), (2, False, "acme bakery", "12 main", "12"), (3, False, "acme bakery", "", "")], "id long, is_query boolean, name string, address string, house string")
    assert got(blocking.block_pairs(blocking.record_keys(rec), 10)) == [(1, 2, 3)]
    assert {r.key for r in blocking.name_pair_keys(rec).collect()} == {"acme|bakery"}
    u = blocking.union_channels(pairs(spark, [("a", "x", 0.5)], "s string, c string, t double"), pairs(spark, [("a", "y", 2)], "s string, c string, k int"), defaults={"t": 0.0, "k": 0})
    assert got(u) == [("a", "x", 0.5, 0), ("a", "y", 0.0, 2)]
    truth = pairs(spark, [("a", "x"), ("a", "y")])
    r = blocking.channel_recall(truth, {"one": pairs(spark, [("a", "x")]), "two": pairs(spark, [("a", "x"), ("a", "y")])}).first()
    assert (r.one_alone, r.combined, r.one_marginal, r.two_marginal) == (0.5, 1.0, 0.0, 0.5)
    g = spark.createDataFrame([(1, True, "tx"), (2, False, ""), (3, False, "oh")], "id long, is_query boolean, grp string")
    assert got(blocking.spread_unknown(g).select("id", "grp")) == [(1, "tx"), (2, "oh"), (2, "tx"), (3, "oh")]
    e = blocking.graph_edges(pairs(spark, [("x", "y")]))
    assert got(e) == [("x", "y"), ("y", "x")] and got(blocking.graph_expand(pairs(spark, [("a", "x")]), e)) == [("a", "y", 1)]
    lone = blocking.lone_address_pairs(spark.createDataFrame([("a", "1 x"), ("b", "2 y"), ("c", "2 y")], "id string, address string"), spark.createDataFrame([("q", "1 x"), ("r", "2 y")], "id string, address string"))
    assert got(lone) == [("a", "q")]
    acr = blocking.acronym_pairs(spark.createDataFrame([("a", ["sncf"], "12", ["longue"])], "id string, initials array<string>, house string, words array<string>"), spark.createDataFrame([("q", "sncf", "12", ["longue"]), ("r", "sncf", "13", ["longue"])], "id string, acronym string, house string, words array<string>"))
    assert got(acr) == [("a", "q")]


def test_dense(spark):
    v = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)], 1) for i in range(20)], "id long, v array<double>, block int")
    top = blocking.dense_topk(v.where("id = 3"), v, 2)
    assert got(top.select("c", "dense_rank")) == [(2, 1), (4, 2)]
    truth = pairs(spark, [(3, 2), (3, 9), (3, 4)], "s long, c long")
    assert math.isclose(blocking.recall_at_k(top, truth, "dense_rank", (2,)).first()[0], 2 / 3)
    assert blocking.recall_at_k(top, truth.limit(0), "dense_rank", (2,)).first()[0] == 1.0
    assert got(blocking.found_ranks(top, truth, "dense_rank").select("c", "found_rank")) == [(2, 1), (4, 2)]
    near = {r.c for r in blocking.dense_topk_lsh(v.where("id = 3"), v, 2).collect()}
    assert near <= set(range(20)) and len(near & {2, 4}) >= 1


def test_hard_names(spark):
    rec = spark.createDataFrame([("e1", True, "US", "acme", "1 x"), ("e2", True, "US", "zinc", "2 x"), ("h", False, "US", "acm", ""), ("n", False, "US", "गुजरात", "3 x"), ("q", False, "US", "acme", "4 x"), ("f", False, "FR", "acme", "")], "id string, is_query boolean, country string, name string, address string")
    v = spark.createDataFrame([("e1", [1.0, 0.0]), ("e2", [0.0, 1.0]), ("h", [0.8, 0.6]), ("n", [0.0, 1.0]), ("q", [1.0, 0.0]), ("f", [1.0, 0.0])], "id string, v array<double>")
    assert got(blocking.hard_name_channel(rec, v, 1).select("s", "c", "hard_emb_rank")) == [("e1", "h", 1), ("e2", "n", 1)]


# sampling


def test_splits(spark):
    df = spark.createDataFrame([(f"s{i}", "US" if i % 3 else "IN", i % 7) for i in range(4000)], "s string, country string, n_matches int")
    t = sampling.assign_splits(df).collect()
    share = Counter(r.split for r in t)
    assert abs(share["A_train"] / 4000 - 0.35) < 0.01 and abs(share["A_val"] / 4000 - 0.05) < 0.01
    folds = Counter(r.fold for r in t if r.split == "B")
    assert set(folds) == set(range(5)) and max(folds.values()) - min(folds.values()) <= 12
    assert all(r.fold == -1 for r in t if r.split != "B")
    assert got(sampling.assign_splits(df.repartition(5))) == got(sampling.assign_splits(df))


def test_triplets(spark):
    truth = spark.createDataFrame([("S1-a", c, "US") for c in ("S2-a1", "S2-a2", "S3-a1")] + [("S1-b", "S3-b1", "US")], "s string, c string, country string")
    pool = spark.createDataFrame([(f"{x}", "US", k) for k, x in enumerate(["S2-a1", "S2-a2", "S3-a1", "S3-b1", "S2-z", "S3-y"])], "id string, country string, k int")
    neg = pairs(spark, [("S1-b", "S2-z")])
    t = sampling.sample_triplets(truth, neg, pool, rounds=40)
    group = {"S1-a": {"S1-a", "S2-a1", "S2-a2", "S3-a1"}, "S1-b": {"S1-b", "S3-b1"}}
    rows = t.collect()
    assert len(rows) == 80
    for r in rows:
        g = next(v for v in group.values() if r.positive in v)
        assert r.anchor in g and r.negative not in g and r.anchor != r.positive
    assert {r.negative for r in rows if r.positive == "S3-b1"} == {"S2-z"}
    assert got(t) == got(sampling.sample_triplets(truth.repartition(3), neg, pool, rounds=40))
    rec = spark.createDataFrame([(x, f"name {x}", "1 Main Road, Allen, TX", "US") for x in ("S1-a", "S1-b", "S2-a1", "S2-a2", "S3-a1", "S3-b1", "S2-z", "S3-y")], "id string, name string, address string, country string")
    text = sampling.render_triplets(t, rec).collect()
    assert all(r.anchor_text == f"name: name {r.anchor} | address: 1 Main Road, Allen, TX | country: US" for r in text)
    assert any(r.positive_text != f"name: name {r.positive} | address: 1 Main Road, Allen, TX | country: US" for r in text)


def changed(spark, op, values, draws=60):
    """All results of an operator on each value, over many ids."""
    df = spark.createDataFrame([(i, v) for v in values for i in range(draws)], "id long, v string")
    out = {v: set() for v in values}
    for r in df.select("v", op(F.col("v"), noise.Draws(F.col("id"), 3)).alias("x")).collect():
        out[r.v].add(r.x)
    return out


def test_noise_operators(spark):
    """Every result of every operator is one its rule allows, and empty or hopeless texts come back."""
    one = lambda op, v: changed(spark, op, [v])[v]
    assert one(noise.change_case, "Oak Mill") == {"OAK MILL"} and one(noise.change_case, "OAK MILL") == {"Oak Mill"}
    assert one(noise.drop_word, "a b c") == {"b c", "a c", "a b"} and one(noise.drop_word, "a") == {"a"}
    assert one(noise.truncate, "a b c") == {"a", "a b"} and one(noise.last_first, "a b c") == {"c a b"}
    assert one(noise.next_word, "a b c") == {"b a c", "a c b"} and one(noise.bracket, "a b") == {"a (b)"}
    assert one(noise.accent, "bcd") == {"bcd"} and one(noise.accent, "bad eL") == {"bád eL", "bad éL"}
    assert one(noise.no_accents, "Élan çà") == {"Elan ca"}
    assert one(noise.domain, "Oak & Mill") == {"oakmill.com", "#oakmill"}
    assert one(noise.swap_legal, "Oak Private Limited") == {"Oak Pvt Ltd", "Oak Private Ltd", "Oak Pvt Limited"} and one(noise.swap_legal, "Oak") == {"Oak"}
    assert one(noise.ampersand, "Oak & Mill") == {"Oak and Mill", "Oak et Mill", "Oak Mill"} and one(noise.ampersand, "Oak et Mill") == {"Oak & Mill"}
    assert one(noise.abbreviate, "12 Boulevard, X") <= {"12 blvd, X", "12 bd, X", "12 bld, X", "12 bvd, X"} and one(noise.abbreviate, "Lanterns") == {"Lan.", "Lant."}
    assert one(noise.legal, "Oak Inc") <= {"Oak", *(f"Oak {f}" for f in noise.SHORT_FORMS)} and one(noise.legal, "Oak") == {f"Oak {f}" for f in noise.SHORT_FORMS}
    assert one(noise.null_part, "a, b") == {"NULL, a, b", "a, NULL, b", "a, b, NULL"} and one(noise.drop_part, "a, b") == {"a", "b"}
    assert one(noise.next_part, "a, b, c") == {"b, a, c", "a, c, b"}
    shuffled = one(noise.shuffle_parts, "a, b, c")
    assert "a, b, c" not in shuffled and len(shuffled) >= 4 and all(sorted(x.split(", ")) == ["a", "b", "c"] for x in shuffled)
    assert one(noise.toggle_unit, "9 Elm, Unit 4, X") == {"9 Elm, X"} and all(x.startswith("9 Elm, ") and x.endswith(", X") for x in one(noise.toggle_unit, "9 Elm, X"))
    assert one(noise.swap_state(F.lit("US")), "9 Elm, nv") == {"9 Elm, Nevada"} and one(noise.swap_state(F.lit("US")), "9 Elm, Nevada") == {"9 Elm, NV"}
    assert one(noise.reformat_house, "12 Elm 7") == {"012 Elm 7", "12- Elm 7", "1-2 Elm 7"} and one(noise.reformat_house, "Elm") == {"Elm"}
    assert one(noise.other_house, "75002 Elm 12") == {"75002 Elm", *(f"75002 Elm {x}" for x in ("10", "11", "13", "14", "12 bis", "12 ter", "12 B", "12-14"))}
    assert one(noise.no_postal, "9 Elm, 75002 Reno") == {"9 Elm, Reno"}
    slips = one(noise.typo, "ab")
    assert slips <= {"b", "a", "aab", "abb", "ab", "sb", "an", "ba"} and len(slips) >= 6
    for op in {*noise.NAME_NOISE.values(), *noise.RATED_NAME.values(), *noise.RATED_ADDRESS.values(), *noise.address_noise(F.lit("India")).values()}:
        assert all(isinstance(x, str) for v in changed(spark, op, ["", "x", " , ", "1", "$1 \\E"], 4).values() for x in v)


def test_noise_kinds(spark):
    names = {
        ("Oak Mill", "OAK MILL"): {"case"}, ("Oak Mill", "Mill Oak"): {"reorder"}, ("Oak Mill Inc", "Oak Mill"): {"legal"}, ("Oak Mill", "Oak"): {"drop"}, ("Oak", "Oak Mill"): {"add"},
        ("Oak & Mill", "Oak Mill"): {"amp"}, ("Lantern Oak", "Lamtern Oak"): {"typo"}, ("Management Oak", "Mgmt Oak"): {"abbrev"}, ("Élan Oak", "elan oak"): {"accent"},
        ("Oak Mill", "oakmill.com"): {"domain"}, ("Oak", "Oak"): {"same"}, ("Oak", "NULL"): {"null"}, ("Oak", ""): {"null"}, ("Oak", "ओक"): {"script"},
    }
    addresses = {
        ("9 Elm, Reno", "9 Elm"): {"comp_drop"}, ("9 Elm", "9 Elm, NULL"): {"null_token", "comp_add"}, ("9 Elm, Reno", "Reno, 9 Elm"): {"comp_reorder"}, ("9 Elm", "11 Elm"): {"house"},
        ("9 Elm, 75002", "9 Elm"): {"postal_drop", "comp_drop"}, ("9 Elm", ""): {"null"}, ("", "null"): {"same"},
    }
    for side, table, order in (("name", names, noise.NAME_KINDS), ("address", addresses, noise.ADDRESS_KINDS)):
        df = spark.createDataFrame([(f"{a}|{b}", a, b) for a, b in table], "k string, a string, b string")
        found = {r.k: {k for k in order if r[k]} for r in noise.noise_rates(df, "a", "b", ["k"], side).collect()}
        for (a, b), want in table.items():
            assert want <= found[f"{a}|{b}"], (a, b, found[f"{a}|{b}"])
            assert not ({"same", "null"} & want) or found[f"{a}|{b}"] == want


def test_noise(spark):
    made = spark.createDataFrame([(i, "Blue Lantern Works Pvt Ltd", "14/2 Canal Road, Nashik, Maharashtra", "India") for i in range(400)], "id long, name string, address string, country string")
    loud = sampling.augment_records(made).collect()
    assert all(r.name.strip() for r in loud) and 2 <= sum(r.address == "" for r in loud) <= 30
    assert sum(r.name != "Blue Lantern Works Pvt Ltd" for r in loud) > 380 and len({r.name for r in loud}) > 60
    rated = sampling.augment_records(made, rates={"name": {"case": 0.5, "drop": 1.0}, "address": {"null_token": 0.2}}).collect()
    assert abs(sum(r.name == r.name.upper() for r in rated) / 400 - 0.5) < 0.1 and all(len(r.name.split()) == 4 for r in rated)
    assert abs(sum("NULL" in r.address for r in rated) / 400 - 0.2) < 0.08
    order = sampling.augment_records(made, rates={"name": {"drop": 1.0, "legal": 1.0}}).collect()
    assert len({r.name for r in order}) > 10
    assert sampling.surface_rates({"upper": 0.2}, {"upper": 0.6}) == {"upper": pytest.approx(0.5)}
    df = spark.createDataFrame([(str(i), "Acme Works Inc", "1 Main Road", "US") for i in range(50)], "id string, name string, address string, country string")
    assert got(sampling.augment_records(df)) == got(sampling.augment_records(df.repartition(4)))
    cells = spark.createDataFrame([("US", 1, 2, 5), ("US", 0, 1, 5)], "country string, n2 int, n3 int, n int")
    records, truth = sampling.proxy_family(df, cells, {"name": {"case": 1.0}}, 0.5)
    assert {x.source for x in records.collect()} == {1, 2, 3} and truth.count() > 0
    assert truth.join(records, truth.c == records.id, "left_anti").count() == 0


def test_sets(spark):
    truth = pairs(spark, [("a", "x"), ("b", "y")])
    cands = pairs(spark, [("a", "x"), ("a", "z"), ("b", "q")])
    assert got(sampling.hard_negatives(cands, truth, pairs(spark, [("a",)], "s string"))) == [("a", "z")]
    rec = spark.createDataFrame([("a", "US", True), ("x", "US", False), ("u", "US", False), ("v", "US", False), ("w", "FR", False)], "id string, country string, is_query boolean")
    t = sampling.eval_set(pairs(spark, [("a",)], "s string"), truth, rec, 1, F.col("id"))
    assert got(t) == [("a", "query", "US"), ("u", "doc", "US"), ("x", "doc", "US")]
    scored = spark.createDataFrame([("a", "x", 1, 0.3, "k"), ("a", "y", 0, 0.9, "k"), ("a", "z", 0, 0.8, "k")], "s string, c string, label int, p double, kind string")
    assert got(sampling.rerank_pairs(scored, {"k": 1})) == [("a", "x", 1, 1), ("a", "x", 1, 2), ("a", "y", 0, 1)]
    assert sampling.stratified_sample(rec, "country", 1, "id").count() == 2
    assert sampling.damage(rec, 1.0, "country").where("country <> ''").count() == 0


# models


def test_models(spark):
    r = random.Random(7)
    rows = [(i, x, r.random(), int(x + 0.2 * r.random() > 0.6), i % 3) for i, x in ((i, r.random()) for i in range(300))]
    df = spark.createDataFrame(rows, "id int, x double, z double, label int, fold int")
    oof, fitted = models.train_oof(df, ["x", "z"], folds=3, maxIter=5)
    assert oof.count() == 300 and decision.auc(oof).first()[0] > 0.95
    assert models.predict_mean(fitted, df, ["x", "z"]).where("p between 0 and 1").count() == 300
    iso = models.isotonic(oof, oof).orderBy("p").collect()
    assert all(a.q <= b.q + 1e-9 for a, b in zip(iso, iso[1:], strict=False))
    slope, _ = models.platt(oof)
    assert slope > 0 and models.apply_platt(oof, (1.0, 0.0)).where("abs(q - p) > 1e-5 and p between 0.001 and 0.999").count() == 0
    t = models.score_pairs(spark.createDataFrame([("a b", "a b", 0.5), ("a", "b", 1.0)], "l string, r string, p double"), models.surrogate_scorer, "l", "r")
    assert got(t.select("p", "rr")) == [(0.5, 1.0), (1.0, None)]
    assert models.bake_off_winner([{"name": "a", "recall": 0.9, "held_out": 0.5}, {"name": "b", "recall": 0.897, "held_out": 0.6}, {"name": "c", "recall": 0.8, "held_out": 0.9}]) == "b"
    v = spark.createDataFrame([(i, [1.0, 0.01 * i] if i < 10 else [0.01 * i, 1.0]) for i in range(20)], "id int, v array<double>")
    k = models.spherical_clusters(v, 2)
    assert models.same_cluster_rate(spark.createDataFrame([(1, 2), (11, 12)], "s int, c int"), k).first().rate == 1.0


# linkage


RAW = [
    ("S1-1", 1, "Marlow Fern Cafe Inc", "1130 Regency Road, Atlanta, GA", "US"), ("S2-1", 2, "MARLOW FERN INC", "01130 REGENCY ROAD, ATL, GA", "US"), ("S3-1", 3, "marlowferncafe.com", "1130- Regency Road, Atlanat, Georgia", "US"),
    ("S1-2", 1, "Galaxy Solutions Pvt Ltd", "47/1 Airport Road, Kolhapur, Maharashtra", "India"), ("S2-2", 2, "Galaxy S0lutions Pvt Ltd.", "NULL, MH, 4-7/1 Airport Road", "India"), ("S3-9", 3, "Galaxy Solutions Pvt Ltd", "47/1 Airport Road", "France"),
]


@pytest.fixture(scope="module")
def records(spark):
    raw = spark.createDataFrame(RAW, "entity_id string, source int, business_name string, business_address string, country string")
    return linkage.build_records(raw).cache()


def test_records(records):
    assert tuple(records.columns) == linkage.RECORD_COLUMNS and len(records.columns) == 22
    t = {r.entity_id: r for r in records.collect()}
    assert t["S3-1"].name_domain == "marlow fern cafe" and t["S1-1"].name_domain == ""
    assert t["S1-2"].house_no == t["S2-2"].house_no == "47/1" and t["S2-2"].state == "maharashtra"
    assert t["S3-1"].block_text.startswith("marlow fern cafe 1130")


def test_candidates_and_features(records):
    cfg = config.merge(config.DEFAULTS, {"tfidf": {"min_df": 1, "max_df": 1.0, "top_k": 3}})
    cands = linkage.block_family(records, cfg).cache()
    found = {(r.s, r.c): r for r in cands.collect()}
    assert ("S1-1", "S2-1") in found and ("S1-1", "S3-1") in found and ("S1-2", "S2-2") in found
    assert ("S1-2", "S3-9") not in found
    f = linkage.pair_features(cands, records)
    assert len(f.columns) == 50 and f.count() == cands.count()
    r = {(x.s, x.c): x for x in f.collect()}["S1-1", "S2-1"]
    assert r.house_cmp == 1 and r.state_cmp == 1 and r.house_num_diff == 0 and r.cand_addr_empty == 0 and r.name_token_set > 80


def test_extra_channels(spark):
    raw = [
        ("S1-1", 1, "Marlow Fern Cafe Inc", "1130 Regency Road, Atlanta, GA", "US"), ("S2-1", 2, "Marlow Fern Cafe", "1130 Regency Road, Atlanta", "US"), ("S3-1", 3, "Marlow Fern", "", "US"), ("S3-2", 3, "Fern Marlow", "77 Harbour Lane, Boise", "US"),
        ("S1-2", 1, "Quartz Mining", "9 Hill Street, Dallas, TX", "US"), ("S2-2", 2, "Zebra Umbrella", "", "US"), ("S2-9", 2, "Marlow Fern Cafe", "1130 Regency Road", "France"),
    ]
    r = linkage.build_records(spark.createDataFrame(raw, "entity_id string, source int, business_name string, business_address string, country string")).cache()
    sparse = pairs(spark, [("S1-1", "S3-1", 0.5, 1, 0, 0.0, 0)], "s string, c string, tfidf_sim double, tfidf_rank int, key_hits int, name_sim double, name_key int")
    f = {(x.s, x.c): x for x in linkage.pair_features(linkage.extra_channels(sparse, r), r).collect()}
    assert {c for _, c in f} == {"S2-1", "S3-1", "S3-2", "S2-2"}
    assert f["S1-1", "S3-2"].from_graph == 1 and f["S1-1", "S3-2"].graph_paths == 1
    assert f["S1-1", "S3-1"].from_hardname == 1 and f["S1-1", "S3-1"].hard_emb_rank == 1 and f["S1-1", "S3-1"].hard_emb_sim > f["S1-2", "S3-1"].hard_emb_sim
    assert f["S1-1", "S2-1"].from_dense == 1 and f["S1-1", "S2-1"].dense_rank == 1 and f["S1-1", "S2-1"].from_hardname == 0
    assert f["S1-1", "S2-1"].emb_cos > 0.5 and f["S1-1", "S2-2"].emb_cos_gap > 0.3


def test_state_groups(spark):
    cols = dict.fromkeys(linkage.RECORD_COLUMNS, "")
    rec = lambda i, source, name, addr, state, country="US": tuple((cols | {"entity_id": i, "source": source, "country": country, "name_core": name, "name_norm": name, "addr_norm": addr, "house_no": addr.split(" ")[0], "state": state, "block_text": f"{name} {addr}"}).values())
    rows = [rec("S1-1", 1, "acme bakery", "12 main", "ga"), rec("S2-1", 2, "acme bakery", "12 main", "al"), rec("S2-2", 2, "acme bakery", "12 main", "tx"), rec("S2-3", 2, "acme bakery", "12 main", "")]
    rows += [rec("S2-4", 2, "acme bakery", "", ""), rec("S1-5", 1, "acme bakery", "12 main", "q", "FR"), rec("S2-5", 2, "acme bakery", "", "", "FR")]
    r = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'source' else 'string'}" for c in linkage.RECORD_COLUMNS)).cache()
    cfg = config.merge(config.DEFAULTS, {"tfidf": {"min_df": 1, "max_df": 1.0}, "groups": {"min_pairs": 1}, "keys": {"max_block": 4}, "name_only": {"max_block": 2}})
    groups = linkage.learn_groups(r, pairs(spark, [("S1-1", "S2-1")]), cfg).cache()
    assert {(x.country, x.state, x.grp) for x in groups.collect()} == {("US", "ga", "US|al+US|ga"), ("US", "al", "US|al+US|ga")}
    by_tfidf = lambda t: {x.c for x in t.where("s = 'S1-1' and tfidf_rank < 999").collect()}
    merged = linkage.block_family(r, cfg, groups).cache()
    assert {"S2-1", "S2-3"} <= by_tfidf(merged) and "S2-2" not in by_tfidf(merged)
    assert {x.c for x in merged.where("s = 'S1-1' and key_hits > 0").collect()} == {"S2-1", "S2-3"}
    assert {(x.s, x.c) for x in merged.where("name_key = 1").collect()} == {("S1-1", "S2-4"), ("S1-5", "S2-5")}
    assert {"S2-1", "S2-2", "S2-3"} <= by_tfidf(linkage.block_family(r, cfg))
