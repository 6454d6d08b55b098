"""Commands over a run directory of Parquet tables: ``python -m entwine.cli --config base.yaml COMMAND``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine import config
from entwine.operators import blocking, decision, models, noise, sampling, windows
from entwine.plans import linkage
from entwine.sources import tables


class Run:
    """One run: its settings, its session and its tables."""

    def __init__(self, cfg: dict, spark: SparkSession):
        self.cfg, self.spark = cfg, spark
        self.data, self.out = cfg["paths"]["data_dir"], cfg["paths"]["run_dir"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}.parquet")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}.parquet")
        return self.read(name)

    def truth(self) -> DataFrame:
        return tables.list_pairs(tables.read_lists(self.spark, f"{self.data}/train_ground_truth.tsv"))

    def entities(self, family: str) -> DataFrame:
        return self.read(f"records_{family}").where("source = 1").select(F.col("entity_id").alias("s"), "country")


def normalize(run: Run, a) -> None:
    for family in a.family:
        run.write(linkage.build_records(tables.read_family(run.spark, run.data, family)), f"records_{family}")


def split(run: Run, a) -> None:
    n = run.truth().groupBy("s").agg(F.count(F.lit(1)).alias("n_matches"))
    c = run.cfg["split"]
    run.write(sampling.assign_splits(run.entities("train").join(n, "s", "left").fillna(0, ["n_matches"]), c["a_train"], c["a_val"], c["n_folds"], seed=run.cfg["seed"]), "splits")


def block_sparse(run: Run, a) -> None:
    """State groups are learned from the truth of ``train`` and kept for the other families."""
    for family in a.family:
        if family == "train":
            run.write(linkage.learn_groups(run.read("records_train"), run.truth(), run.cfg), "state_groups")
        pairs = run.write(linkage.block_family(run.read(f"records_{family}"), run.cfg, run.read("state_groups")), f"cand_sparse_{family}")
        if family == "train":
            print("completeness", decision.pair_completeness(pairs, run.truth()).first()[0])
        print(decision.candidates_per_entity(pairs, run.entities(family)).first())


def _features(run: Run, family: str) -> DataFrame:
    """Over all channels. ``dense.names`` and ``dense.texts`` of the settings name tables of supplied vectors (``NAME_FAMILY``)."""
    records = run.read(f"records_{family}")
    supplied = [run.read(f"{t}_{family}") if t else None for t in (run.cfg["dense"].get("names"), run.cfg["dense"].get("texts"))]
    pairs = run.write(linkage.extra_channels(run.read(f"cand_sparse_{family}"), records, *supplied, run.cfg, run.read("state_groups")), f"cand_all_{family}")
    return run.write(linkage.pair_features(pairs, records), f"features_{family}")


def matcher(run: Run, a) -> None:
    """Out-of-fold scores over split B, and the threshold of best macro F0.5."""
    folds = run.read("splits").where("split = 'B'").select("s", "fold")
    truth = run.truth()
    df = _features(run, "train").join(folds, "s").join(truth.withColumn("label", F.lit(1)), ["s", "c"], "left").fillna(0, ["label"])
    oof, fitted = models.train_oof(df, list(linkage.FEATURES), run.cfg["split"]["n_folds"])
    oof = run.write(oof.select("s", "c", "fold", "label", "p"), "oof")
    for i, m in enumerate(fitted):
        m.write().overwrite().save(f"{run.out}/model_{i}")
    grid = decision.threshold_grid(oof, truth.join(folds, "s", "left_semi"), folds.select("s"), [round(0.05 * i, 2) for i in range(1, 20)])
    print("tau", decision.best_threshold(grid))
    print(tables.markdown(grid.orderBy("tau")))


def _score(run: Run, family: str) -> DataFrame:
    from pyspark.ml.classification import GBTClassificationModel

    fitted = [GBTClassificationModel.load(f"{run.out}/model_{i}") for i in range(run.cfg["split"]["n_folds"])]
    return run.write(models.predict_mean(fitted, _features(run, family), list(linkage.FEATURES)).select("s", "c", "p"), f"scored_{family}")


def _submit(run: Run, scored: DataFrame, family: str, tau: float, out: str) -> None:
    ents = run.entities(family).withColumn("pos", F.monotonically_increasing_id())
    kept = scored.where(F.col("p") >= run.cfg["decide"]["filter"])
    matches, cands = tables.submission(ents, decision.decide(kept, tau), kept)
    tables.write_tsv(matches, f"{out}/matched")
    tables.write_tsv(cands, f"{out}/candidates")
    print(tables.check_submission(matches, cands, ents) or "submission is valid")


def predict(run: Run, a) -> None:
    _submit(run, _score(run, a.family[0]), a.family[0], a.tau or run.cfg["decide"]["tau"], a.out or f"{run.out}/submission")


def stage2(run: Run, a) -> None:
    """Support by linked duplicates as features of a second model over the out-of-fold scores."""
    pairs = run.read("cand_sparse_train")
    edges = blocking.graph_edges(pairs.where("key_hits >= 2"))
    t = windows.second_stage_features(run.read("oof"), edges, support=run.cfg["decide"]["support"])
    names = ["logit_p", "rank_p", "p_max", "p_gap", "n_ge50", "n_ge70", "sum_p", "n_cands", "sup_max", "sup_mean", "sup_deg", "sup_n70", "sup_p"]
    oof, _ = models.train_oof(t.withColumnRenamed("p", "p1"), names, run.cfg["split"]["n_folds"])
    run.write(oof.select("s", "c", "fold", "label", "p"), "oof_stage2")


def bakeoff(run: Run, a) -> None:
    """Recall of supplied vectors (table ``vectors_MODEL``: id, v, block) over the evaluation set."""
    v = run.read(f"vectors_{a.model}")
    val = run.read("splits").where("split = 'A_val'").select(F.col("s").alias("id"))
    top = blocking.dense_topk(v.join(val, "id", "left_semi"), v.join(val, "id", "left_anti"), 100)
    print(blocking.recall_at_k(top, run.truth().join(val.withColumnRenamed("id", "s"), "s", "left_semi"), "dense_rank", (10, 50, 100)).first())


def proxy(run: Run, a) -> None:
    raw = tables.read_family(run.spark, run.data, "train")
    r = raw.select(F.col("entity_id").alias("id"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country", "source")
    truth = run.truth()
    if a.action == "measure":
        own = r.select(F.col("id").alias("s"), F.col("name").alias("s_name"), F.col("address").alias("s_address"), "country")
        other = r.select(F.col("id").alias("c"), F.col("name").alias("c_name"), F.col("address").alias("c_address"), "source")
        pairs = truth.join(own, "s").join(other, "c")
        for side in ("name", "address"):
            run.write(noise.noise_rates(pairs, f"s_{side}", f"c_{side}", ["country", "source"], side), f"noise_{side}")
        run.write(sampling.match_histogram(truth, r), "match_counts")
    elif a.action == "build":
        records, pairs = sampling.proxy_family(r.where("source = 1").drop("source"), run.read("match_counts"), json.loads(a.rates), seed=run.cfg["seed"])
        run.write(records, "proxy_records")
        run.write(pairs, "proxy_truth")
    elif a.action == "score":
        print(decision.evaluate(run.read("proxy_pred"), run.read("proxy_truth"), run.read("proxy_records").where("source = 1").select(F.col("id").alias("s"))).first())
    else:
        run.write(sampling.surface_shares(r, "name", "country"), "surface")


def show_config(run: Run, a) -> None:
    print(json.dumps(run.cfg, indent=1))


COMMANDS = {"normalize": normalize, "split": split, "block-sparse": block_sparse, "matcher": matcher, "predict": predict, "stage2": stage2, "bakeoff": bakeoff, "proxy": proxy, "show-config": show_config}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="entwine")
    p.add_argument("--config", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        if name in ("normalize", "block-sparse", "predict"):
            s.add_argument("--family", nargs="+", default=["train", "test"] if name != "predict" else ["test"])
        if name == "predict":
            s.add_argument("--tau", type=float)
            s.add_argument("--out")
        if name == "bakeoff":
            s.add_argument("--model", required=True)
        if name == "proxy":
            s.add_argument("action", choices=["measure", "build", "score", "calibrate"])
            s.add_argument("--rates", default="{}")
    a = p.parse_args(argv)
    cfg = config.merge(config.DEFAULTS, config.load_config(a.config))
    COMMANDS[a.command](Run(cfg, spark or SparkSession.builder.getOrCreate()), a)


if __name__ == "__main__":
    main()
