"""The pipeline's stages against plain versions of what each has to do."""

import random

import corpus_pipeline
from entwine.llm import secrets
from tests.llm.test_operators import DOC, brute_near, lower

WORDS = "amber birch cedar dune ember fern grove heath iris juniper kelp larch moss nettle oak pine quartz reed sage thorn umber vale willow yarrow zinc".split()


def made(tmp_path, spark):
    r = random.Random(4)

    def prose(n):
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    rows = [[i, prose(60)] for i in range(200)]
    for i in range(0, 150, 3):
        rows[i][1] += " vilex grubbish vilexon"
    rows += [[300 + i, rows[i][1].upper()] for i in (1, 2)] + [[400 + i, rows[i][1] + " tail"] for i in (4, 5)]
    rows += [[500, "password = Zx81kQpL0vTn4Rw7bY2m " + prose(40)], [501, None], [502, ""]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows], DOC)
    labels = spark.createDataFrame([(i, 1, int(i < 150 and i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages(tmp_path, spark):
    rows = made(tmp_path, spark)
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        if name != "packing":
            assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else {}
        if name == "toxicity":
            bad = {i for i, t in rows if "vilex" in (t or "")}
            assert len(bad & set(after)) <= 2 and len(set(before) - bad - set(after)) <= 2
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[lower(t)] = max(i, best.get(lower(t), i))
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            assert set(after) == {c for _, c in brute_near(list(before.items())).values()}
        elif name == "secrets":
            assert set(after) == set(before)
            for i, t in after.items():
                assert (t is None) == (before[i] is None) and len(t or "") == len(before[i] or "")
                assert not secrets.base_spans(t or "")
            assert after[500] != before[500]
        else:
            assert {r.doc_id for r in docs.collect()} == set(before)
        kept[name] = len(after)
    assert kept["toxicity"] > kept["exact_dedup"] > kept["near_dedup"] == kept["secrets"]
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
