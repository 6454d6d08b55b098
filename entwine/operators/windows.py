"""Ranking of candidates around their entity and of entities around their candidate.

A scored pair table has an entity ``s``, a candidate ``c`` and scores.  Ranks break
ties by the other id, so results do not depend on the order of rows.  Missing
scores are null.  All signals of one key are computed over one shuffle of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING_RANK = 99


def rank_within(df: DataFrame, key: str, score: str, tie: str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(score), F.asc(tie))))


def top_n(df: DataFrame, key: str, score: str, tie: str, n: int, name: str = "rank") -> DataFrame:
    return rank_within(df, key, score, tie, name).where(F.col(name) <= n)


def gap_to_best(score: str, key: str) -> Column:
    return F.max(score).over(Window.partitionBy(key)) - F.col(score)


def group_size(key: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(key))


def running_total(value: str, key: str, *order: Column) -> Column:
    return F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_max(value: str, key: str, *order: Column) -> Column:
    return F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def second_max(value: str, key: str) -> Column:
    """The second largest value of the group, 0 if it has one row."""
    w = Window.partitionBy(key).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.nth_value(value, 2).over(w), F.lit(0.0))


def stack_features(df: DataFrame, rerank: str = "rr", p: str = "p", s: str = "s", c: str = "c") -> DataFrame:
    """Rank and gap of two scores within the entity; a row without the first has rank 99 and no gap."""
    by = Window.partitionBy(s)
    has = F.col(rerank).isNotNull()
    return df.select(
        "*",
        has.cast("int").alias("has_rr"),
        F.when(has, F.row_number().over(by.orderBy(F.desc_nulls_last(rerank), c))).otherwise(MISSING_RANK).alias("rr_rank"),
        (F.max(rerank).over(by) - F.col(rerank)).alias("rr_gap"),
        F.row_number().over(by.orderBy(F.desc(p), c)).alias("p_rank"),
        (F.max(p).over(by) - F.col(p)).alias("p_gap"),
        F.count(F.lit(1)).over(by).alias("n_cands"),
    )


def competition_table(df: DataFrame, score: str, s: str = "s", c: str = "c", prefix: str = "") -> DataFrame:
    """How each entity stands among those that compete for its candidate: rank, margin, competitors.

    The margin is to the second if first, else to the best; a sole competitor has none.
    """
    order = Window.partitionBy(c).orderBy(F.desc(score), s)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(order)
    rival = F.when(rank == 1, F.nth_value(score, 2).over(whole)).otherwise(F.first(score).over(whole))
    return df.where(F.col(score).isNotNull()).select(
        s, c, rank.alias(f"{prefix}crank"), (F.col(score) - rival).alias(f"{prefix}cmargin"), F.count(F.lit(1)).over(Window.partitionBy(c)).alias(f"{prefix}ncomp")
    )


def competition_lookup(pairs: DataFrame, table: DataFrame, s: str = "s", c: str = "c", prefix: str = "") -> DataFrame:
    """Competition of given pairs; an absent one has rank 99, no margin and no competitors."""
    out = pairs.join(table, [s, c], "left")
    return out.withColumns({f"{prefix}crank": F.coalesce(f"{prefix}crank", F.lit(MISSING_RANK)), f"{prefix}ncomp": F.coalesce(f"{prefix}ncomp", F.lit(0))})


def competition_signals(df: DataFrame, signals: dict[str, str], s: str = "s", c: str = "c") -> DataFrame:
    """``competition_table`` of several scores (prefix to column) over one shuffle by candidate."""
    columns: list[Column] = [F.col(s), F.col(c)]
    for prefix, score in signals.items():
        order = Window.partitionBy(c).orderBy(F.desc_nulls_last(score), s)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        here, rank = F.col(score).isNotNull(), F.row_number().over(order)
        rival = F.when(rank == 1, F.nth_value(score, 2).over(whole)).otherwise(F.first(score).over(whole))
        n = F.count(score).over(Window.partitionBy(c))
        columns += [F.when(here, rank).otherwise(MISSING_RANK).alias(f"{prefix}crank"), F.when(here, F.col(score) - rival).alias(f"{prefix}cmargin"), F.when(here, n).otherwise(0).alias(f"{prefix}ncomp")]
    return df.select(*columns)


def name_counts(pairs: DataFrame, s_records: DataFrame, c_records: DataFrame) -> DataFrame:
    """Candidate-side facts of pairs (s, c): empty address, equal core name, and how many records of the country share each name.

    Record tables have id, country, name, address.
    """
    def counted(r: DataFrame, side: str) -> DataFrame:
        n = r.groupBy("country", "name").agg(F.count(F.lit(1)).alias(f"{side}_name_cnt"))
        return r.join(n, ["country", "name"]).select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("address").alias(f"{side}_address"), f"{side}_name_cnt")

    out = pairs.join(counted(s_records, "s"), "s").join(counted(c_records, "c"), "c")
    return out.select(*pairs.columns, (F.col("c_address") == "").cast("int").alias("cand_noaddr"), (F.col("s_name") == F.col("c_name")).cast("int").alias("name_exact"), F.col("s_name_cnt").alias("s1_name_cnt"), F.col("c_name_cnt").alias("cand_name_cnt"))


def model_competition(df: DataFrame, p: str = "p", s: str = "s", c: str = "c") -> DataFrame:
    """Competition on the model's score, the other strong claims and the share of all claims on the candidate."""
    by = Window.partitionBy(c)
    strong = (F.col(p) >= 0.5).cast("int")
    extra = df.select(s, c, (F.sum(strong).over(by) - strong).alias("a_nhi"), (F.col(p) / F.greatest(F.sum(p).over(by), F.lit(1e-6))).alias("a_share"))
    return competition_table(df, p, s, c, "a_").join(extra, [s, c])


def cluster_support(df: DataFrame, similarity: Column, p: str = "p", s: str = "s", c: str = "c", confident: float = 0.9, least: float = 0.01) -> DataFrame:
    """For each pair: the entity's other confident candidates, and the largest similarity to one of them.

    ``similarity`` is an expression over the columns ``l`` and ``r`` (structs of both rows).
    """
    sure = df.where(F.col(p) >= confident)
    n = sure.groupBy(s).agg(F.count(F.lit(1)).alias("__n"))
    left = df.where(F.col(p) >= least).select(F.struct(*df.columns).alias("l"))
    right = sure.select(F.struct(*df.columns).alias("r"))
    near = left.join(right, (F.col(f"l.{s}") == F.col(f"r.{s}")) & (F.col(f"l.{c}") != F.col(f"r.{c}")))
    near = near.groupBy(F.col(f"l.{s}").alias(s), F.col(f"l.{c}").alias(c)).agg(F.max(similarity).alias("sib_max"))
    own = (F.col(p) >= confident).cast("int")
    return df.join(n, s, "left").join(near, [s, c], "left").select(*[df[x] for x in df.columns], (F.coalesce("__n", F.lit(0)) - own).alias("s1_nconf"), "sib_max")


def address_counts(pairs: DataFrame, s_records: DataFrame, c_records: DataFrame) -> DataFrame:
    """How many entities share the entity's and the candidate's address (0 if the candidate has none). Record tables have id, country, address."""
    by = ["country", "address"]
    counts = s_records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    left = s_records.join(counts, by).select(F.col("id").alias("s"), F.col("n").alias("s1_addr_cnt"))
    right = c_records.join(counts, by, "left").select(F.col("id").alias("c"), F.when(F.col("address") == "", 0).otherwise(F.coalesce("n", F.lit(0))).alias("cand_addr_s1cnt"))
    return pairs.join(left, "s").join(right, "c")


def second_stage_features(df: DataFrame, edges: DataFrame, p: str = "p", s: str = "s", c: str = "c", support: float = 0.3, only: list[str] | None = None, **limits: int) -> DataFrame:
    """Score context within the entity (``only`` some of it, if given), and support by the entity's other candidates that are linked to this one.

    ``edges`` is symmetric: (a, b), or (b, near) with lists of a; repeated ones count once.
    Pairs of at least ``support`` are walked to their neighbours.
    """
    from entwine.operators.support import with_support

    by = Window.partitionBy(s)
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    context = {
        "logit_p": F.ln(clipped / (1 - clipped)), "rank_p": F.row_number().over(by.orderBy(F.desc(p), F.asc_nulls_last(c))), "p_max": F.max(p).over(by), "p_gap": F.max(p).over(by) - F.col(p),
        "n_ge50": F.sum((F.col(p) >= 0.5).cast("int")).over(by), "n_ge70": F.sum((F.col(p) >= 0.7).cast("int")).over(by), "sum_p": F.sum(p).over(by), "n_cands": F.count(F.lit(1)).over(by),
    }
    base = df.select("*", *[x.alias(name) for name, x in context.items() if only is None or name in only])
    return with_support(base, edges, p, s, c, support, **limits).withColumn("sup_p", F.col("sup_max") * F.col(p))


def embedding_support(df: DataFrame, vectors: DataFrame, q: str = "p", s: str = "s", c: str = "c", low: float = 0.01, high: float = 0.99, confident: float = 0.5) -> DataFrame:
    """Cosine of uncertain candidates to the entity's other confident ones. ``vectors`` has c and v (unit length)."""
    from entwine.functions.similarity import dot_col

    held = df.join(vectors, c)
    left = held.where(F.col(q).between(low, high)).select(s, F.col(c), F.col("v").alias("v1"))
    right = held.where(F.col(q) >= confident).select(s, F.col(c).alias("c2"), F.col("v").alias("v2"), F.col(q).alias("q2"))
    near = left.join(right, s).where(F.col(c) != F.col("c2")).withColumn("cos", dot_col(F.col("v1"), F.col("v2")))
    return near.groupBy(s, c).agg(F.max("cos").alias("emb_max"), F.avg("cos").alias("emb_mean"), F.max(F.col("cos") * F.col("q2")).alias("emb_maxq"), F.sum((F.col("cos") >= 0.8).cast("int")).alias("emb_n80"))


def orphan_features(df: DataFrame, edges: DataFrame, p: str = "p", s: str = "s", c: str = "c") -> DataFrame:
    """Of a candidate's neighbours: how many, also wanted by the entity, wanted by none, owned by another.

    ``df`` holds a pair once, ``edges`` an edge once.  All but the second are counted
    by candidate: a neighbour that the entity wants is owned by somebody, so those
    owned by another are the owned ones less the entity's.  Only wanted pairs walk
    along the edges.
    """
    best = df.groupBy(F.col(c).alias("b")).agg(F.max(p).alias("best"))
    top = F.coalesce("best", F.lit(0.0))
    around = edges.select(F.col("a").alias(c), "b").join(best, "b", "left").groupBy(c).agg(F.count(F.lit(1)).alias("n_nb"), F.sum((top < 0.1).cast("int")).alias("n_orphan"), F.sum((top >= 0.5).cast("int")).alias("__owned"))
    wanted = df.where(F.col(p) >= 0.5).select(s, F.col(c).alias("b"))
    same = wanted.join(edges.select(F.col("a").alias(c), "b"), "b").groupBy(s, c).agg(F.count(F.lit(1)).alias("__same"))
    n_same = F.coalesce("__same", F.lit(0))
    return df.select(s, c).join(around, c).join(same, [s, c], "left").select(s, c, "n_nb", n_same.alias("n_same"), "n_orphan", (F.col("__owned") - n_same).alias("n_owned"))


def hidden_competition(df: DataFrame, hidden: DataFrame, score: str, s: str = "s", c: str = "c", prefix: str = "") -> DataFrame:
    """``competition_table`` without the hidden entities (a table of ``s``)."""
    return competition_table(df.join(hidden.select(s).distinct(), s, "left_anti"), score, s, c, prefix)
