"""Names, commands and the stream."""

import json

from pyspark.sql import functions as F

from entwine import cli
from entwine.operators import blocking, names
from entwine.streaming.incremental import link_stream


def test_spelling(spark):
    voc = spark.createDataFrame([("US", "bakery", 9), ("US", "bakers", 4), ("US", "solutions", 7), ("US", "rare", 1)], "country string, tok string, freq int")
    toks = spark.createDataFrame([("US", t) for t in ("bakary", "solutoins", "bakery", "qqqqqq", "123456")], "country string, tok string")
    got = {r.tok: r.fixed for r in names.correct_words(toks, voc).collect()}
    assert got == {"bakary": "bakery", "solutoins": "solutions"}


def test_name_features(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "s string, c string")
    rec = spark.createDataFrame([("a", "US", "acme works", "1 main"), ("x", "US", "acme works", "1 main"), ("y", "US", "zzz", "2 side")], "id string, country string, name string, address string")
    got = {r.c: r for r in names.name_cosines(pairs, rec).collect()}
    assert abs(got["x"].name_cos - 1) < 1e-9 and got["y"].name_cos == 0 and abs(got["x"].addr_cos - 1) < 1e-9
    df = spark.createDataFrame([("societe nationale", "SN SARL"), ("societe", "Societe")], "core string, raw string")
    assert [(r.acr_cand, r.acr_match) for r in names.acronym_features(df, "core", "raw").collect()] == [(1, 1), (0, 0)]
    got = {r.c: r for r in names.cleaned_competition(pairs, rec.where("id = 'a'"), rec.where("id <> 'a'")).collect()}
    assert got["x"].cn_exact == 1 and got["x"].cn_s1cnt == 1 and got["x"].cn_crank == 1
    keys = spark.createDataFrame([("le cafe du nord", "12 rue de la paix, paris")], "n string, a string").select(names.french_name_key(F.col("n")), names.french_address_key(F.col("a"))).first()
    assert tuple(keys) == ("cafe nord", "12|rue de la")


def test_commands(spark, tmp_path, capsys):
    data = tmp_path / "data"
    data.mkdir()
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    words = "amber birch cedar dune ember fern grove heath iris juniper kelp larch moss nettle oak pine".split()
    one, two, three, truth = [], [], [], []
    for i in range(48):
        n, a = f"{words[i % 16]} {words[i * 7 % 16]}{i} works inc", f"{i + 1} {words[i * 5 % 16]} road, allen, tx"
        one.append(f"S1-{i}\t{n}\t{a}\tUS")
        two.append(f"S2-{i}\t{n.upper()}\t{a}\tUS")
        three.append(f"S3-{i}\t{words[i * 3 % 16]} other{i}\t{a}\tUS")
        truth.append(f"S1-{i}\tS2-{i}")
    for family in ("train", "test"):
        for k, rows in ((1, one), (2, two), (3, three)):
            (data / f"{family}_source{k}.tsv").write_text(head + "\n".join(rows) + "\n")
    (data / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join(truth) + "\n")
    cfg = tmp_path / "c.yaml"
    cfg.write_text(json.dumps({"paths": {"data_dir": str(data), "run_dir": str(tmp_path / "run")}, "tfidf": {"min_df": 1, "max_df": 1.0, "top_k": 5}, "split": {"n_folds": 2}}))
    for command in (["show-config"], ["normalize"], ["split"], ["block-sparse"], ["matcher"], ["stage2"], ["predict", "--tau", "0.5"], ["proxy", "measure"]):
        cli.main(["--config", str(cfg), *command], spark)
    out = capsys.readouterr().out
    assert "completeness 1.0" in out and "submission is valid" in out
    assert spark.read.parquet(f"{tmp_path}/run/oof_stage2.parquet").count() > 0


def test_stream(spark, tmp_path):
    ents = spark.createDataFrame([("s1", ["a", "b"]), ("s2", ["c", "d"])], "s string, words array<string>")
    spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["c", "x"]), ("c3", ["q"])], "c string, words array<string>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("c string, words array<string>").parquet(f"{tmp_path}/in")
    link_stream(stream, ents, f"{tmp_path}/out", f"{tmp_path}/ck", 0.3).awaitTermination(60)
    assert {(r.s, r.c) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("s1", "c1"), ("s2", "c2")}
    assert blocking.graph_edges(ents.select("s", F.lit("z").alias("c"))).count() == 4
