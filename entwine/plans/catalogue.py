"""Registered queries of the linkage operators over the shared tables, with SQL that has to agree.

Stand-ins: a document's language is its country, ``doc_id % 3`` its source (0 is
source 1), suppliers compete for parts, and equal texts are true matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entwine.functions import similarity, text
from entwine.operators import blocking, decision, models, noise, sampling, windows
from entwine.operators.support import group_lists
from entwine.plans import linkage
from entwine.scratch import Scratch
from entwine.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


# Shared inputs, in both languages ---------------------------------------------


def claims(spark, d, by_supplier: bool = False) -> DataFrame:
    """(s, c, qty, p): suppliers' claims on parts, if asked with a supplier's in one partition."""
    t = table(spark, d, "lineitem")
    if by_supplier:  # of about half a million lines, whatever the setting: chunks of suppliers are cut from them
        t = t.select("l_suppkey", "l_partkey", "l_quantity").repartition(max(2 * spark.sparkContext.defaultParallelism, t.count() >> 19), "l_suppkey")
    t = t.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("c")).agg(F.sum("l_quantity").alias("qty"))
    return t.withColumn("p", F.least(F.lit(1.0), F.col("qty") / 100.0))


CLAIMS = "claims AS (SELECT l_suppkey AS s, l_partkey AS c, sum(l_quantity) AS qty, least(1.0, sum(l_quantity) / 100.0) AS p FROM lineitem GROUP BY 1, 2)"


def owned(spark, d) -> DataFrame:
    """True pairs: a line of at least 48 units."""
    return table(spark, d, "lineitem").where("l_quantity >= 48").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("c")).distinct()


OWNED = "truth AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS c FROM lineitem WHERE l_quantity >= 48)"


def suppliers(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("nation"))


SUPPLIERS = "ent AS (SELECT s_suppkey AS s, s_nationkey AS nation FROM supplier)"
DECIDED = "pred AS (SELECT s, c FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p DESC, s) AS o FROM claims WHERE p >= 0.6) WHERE o = 1)"
COUNTS = "cnt AS (SELECT e.s, e.nation, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred, coalesce(p.tp, 0) AS tp FROM ent e LEFT JOIN (SELECT s, count(*) AS n FROM truth GROUP BY s) t USING (s) LEFT JOIN (SELECT pred.s, count(*) AS n, count(truth.c) AS tp FROM pred LEFT JOIN truth ON pred.s = truth.s AND pred.c = truth.c GROUP BY 1) p USING (s))"
F05 = "(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END)"
JUDGED = f"WITH {CLAIMS}, {OWNED}, {SUPPLIERS}, {DECIDED}, {COUNTS}"


def predicted(spark, d) -> DataFrame:
    return decision.decide(claims(spark, d), 0.6).select("s", "c")


def doc_tokens(spark, d) -> DataFrame:
    """(id, is_query, country, tok): distinct lower-cased words."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("is_query"), F.col("lang").alias("country"), F.explode(F.split(F.lower("text"), "[ \n]+")).alias("tok"))
    return t.where("tok <> ''").distinct()


DOC_TOKENS = "tok AS (SELECT DISTINCT doc_id AS id, doc_id % 3 = 0 AS is_query, lang AS country, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS tok FROM documents), toks AS (SELECT * FROM tok WHERE tok <> '')"
RARE = """tl AS (SELECT * FROM toks WHERE length(tok) >= 3 AND NOT regexp_matches(tok, '^[0-9]+$')),
    df AS (SELECT country, tok, count(*) AS df FROM tl GROUP BY 1, 2),
    rare AS (SELECT id, is_query, country, tok, row_number() OVER (PARTITION BY id ORDER BY df, tok) AS pos FROM tl JOIN df USING (country, tok) QUALIFY pos <= 3)"""
RARE_PAIRS = """small AS (SELECT country, tok FROM rare GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 100),
    k AS (SELECT rare.* FROM rare JOIN small USING (country, tok)),
    hits AS (SELECT a.id AS s, b.id AS c, count(*) AS key_hits FROM k a JOIN k b ON a.country = b.country AND a.tok = b.tok WHERE a.is_query AND NOT b.is_query GROUP BY 1, 2)"""


def rare_tokens(spark, d) -> DataFrame:
    t = doc_tokens(spark, d)
    rare = blocking.rarest_tokens(t, 3, 3, ("country",))
    return rare.withColumn("is_query", F.col("id") % 3 == 0)


def rare_pairs(spark, d) -> DataFrame:
    return blocking.block_pairs(rare_tokens(spark, d).withColumn("key", F.col("tok")), 100, ("country",))


def copies(spark, d) -> DataFrame:
    """(s, c): equal texts; the least id of source 1 stands for the group."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    s = t.where("id % 3 = 0").groupBy("h").agg(F.min("id").alias("s"))
    return t.where("id % 3 <> 0").join(s, "h").select("s", F.col("id").alias("c"))


COPIES = "copies AS (SELECT s, d.doc_id AS c FROM documents d JOIN (SELECT text, min(doc_id) AS s FROM documents WHERE doc_id % 3 = 0 GROUP BY text) g ON d.text = g.text WHERE d.doc_id % 3 <> 0)"


def doc_entities(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("s"), F.col("lang").alias("country"))


DOC_ENTITIES = "docs1 AS (SELECT doc_id AS s, lang AS country FROM documents WHERE doc_id % 3 = 0)"

# Flagship -------------------------------------------------------------------------


@query(f"""
    WITH {DOC_TOKENS}, {RARE}, {RARE_PAIRS},
    n AS (SELECT id, count(*) AS n FROM toks GROUP BY 1),
    j AS (SELECT h.s, h.c, count(*) AS hit FROM hits h JOIN toks a ON a.id = h.s JOIN toks b ON b.id = h.c AND a.tok = b.tok GROUP BY 1, 2),
    p AS (SELECT h.s, h.c, key_hits, round(coalesce(hit, 0) / (x.n + y.n - coalesce(hit, 0)), 6) AS p FROM hits h LEFT JOIN j USING (s, c) JOIN n x ON x.id = h.s JOIN n y ON y.id = h.c)
    SELECT s, c, key_hits, p FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p DESC, s) AS o FROM p WHERE p >= 0.5) WHERE o = 1""")
def flagship_link_documents(spark, d):
    """Key blocks on rare words, word Jaccard, one owner per document."""
    toks = doc_tokens(spark, d).groupBy("id").agg(F.collect_set("tok").alias("t"))
    pairs = rare_pairs(spark, d).join(toks.select(F.col("id").alias("s"), F.col("t").alias("ts")), "s").join(toks.select(F.col("id").alias("c"), F.col("t").alias("tc")), "c")
    scored = pairs.select("s", "c", "key_hits", _r(similarity.jaccard_col(F.col("ts"), F.col("tc"))).alias("p"))
    return decision.decide(scored, 0.5)


# Sources and sinks ----------------------------------------------------------------


@query(f"WITH {COPIES} SELECT s, c FROM copies")
def explode_truth_pairs(spark, d):
    lists = copies(spark, d).groupBy("s").agg(F.array_join(F.collect_list(F.col("c").cast("string")), ",").alias("ids"))
    return tables.list_pairs(lists.select("s", tables.split_ids(F.col("ids")).alias("ids"))).select("s", F.col("c").cast("long").alias("c"))


@query(f"WITH {COPIES}, {DOC_ENTITIES} SELECT CAST(s AS VARCHAR) AS s, coalesce(string_agg(DISTINCT CAST(c AS VARCHAR), ',' ORDER BY CAST(c AS VARCHAR)), '') AS matched_entity_ids FROM docs1 LEFT JOIN copies USING (s) GROUP BY s")
def collect_match_lists(spark, d):
    pairs = copies(spark, d).select(F.col("s").cast("string").alias("s"), F.col("c").cast("string").alias("c"))
    return tables.collect_lists(doc_entities(spark, d).select(F.col("s").cast("string").alias("s")), pairs, "matched_entity_ids")


@query(f"WITH {COPIES}, {DOC_TOKENS}, {RARE}, {RARE_PAIRS}, free AS (SELECT DISTINCT s, c FROM hits WHERE key_hits >= 2 AND c NOT IN (SELECT c FROM copies)) SELECT s, c FROM copies UNION SELECT s, c FROM free")
def splice_matches(spark, d):
    pairs = rare_pairs(spark, d)
    return tables.splice(copies(spark, d), pairs, pairs.where("key_hits >= 2"))[0]


# Text ------------------------------------------------------------------------------


@query("""
    WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(regexp_replace(replace(lower(p_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('null', 'the', 'mr', 'mrs', 'ms', 'shri', 'sri', 'smt')) AS t FROM part)
    SELECT p_partkey, array_to_string([t[i] for i in range(1, len(t) + 1) if i = 1 OR t[i] <> t[i - 1]], ' ') AS name_norm FROM w""")
def name_tokens_clean(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.name_words_col(F.lower("p_name")), " ").alias("name_norm"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(p_name, ' '), lambda x: x <> '')), ' ') AS name_sorted FROM part")
def sorted_name(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sorted_name_col(F.col("p_name")).alias("name_sorted"))


_SKELETON = "w"
for _a, _b in text.DIGRAPHS:
    _SKELETON = f"replace({_SKELETON}, '{_a}', '{_b}')"
_DOUBLED = "".join(f", '{c}{c}+', '{c}', 'g')" for c in "abcdefghijklmnopqrstuvwxyz")
_SINGLE = "regexp_replace(" * 26 + _SKELETON + _DOUBLED


@query(f"""
    WITH w AS (SELECT p_partkey, i, w FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w, generate_subscripts(string_split(lower(p_name), ' '), 1) AS i FROM part) WHERE w <> ''),
    k AS (SELECT p_partkey, i, CASE WHEN regexp_matches(w, '^[a-z]+$') THEN {_SINGLE} ELSE w END AS k, w FROM w)
    SELECT p_partkey, string_agg(CASE WHEN regexp_matches(w, '^[a-z]+$') THEN substr(k, 1, 1) || regexp_replace(substr(k, 2), '[aeiou]', '', 'g') ELSE k END, ' ' ORDER BY i) AS skeleton FROM k GROUP BY 1""")
def skeleton_key(spark, d):
    return table(spark, d, "part").select("p_partkey", text.skeleton_col(F.lower("p_name")).alias("skeleton"))


@query(r"""
    WITH h AS (SELECT page_id, trim(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))) AS h FROM pages)
    SELECT page_id, replace(regexp_replace(regexp_replace(h, '^(#|www\.)', ''), '(\.[a-z]{2,4})+$', ''), '-', '') AS body,
           length(h) >= 6 AND (contains(h, '.') OR starts_with(h, '#')) AND regexp_full_match(h, '#?(www\.)?[a-z0-9\-]+(\.[a-z]{2,4}){0,2}') AS is_domain FROM h""")
def domain_body(spark, d):
    h = F.trim(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)))
    return table(spark, d, "pages").select("page_id", text.domain_body_col(h).alias("body"), text.domain_col(h).alias("is_domain"))


@query("SELECT c_custkey, 'name: ' || c_name || ' | address: ' || c_mktsegment || ' | country: ' || n_name AS record FROM customer JOIN nation ON c_nationkey = n_nationkey")
def record_text(spark, d):
    t = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.select("c_custkey", text.record_text_col(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name")).alias("record"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[\\x{0900}-\\x{0DFF}]') AS native FROM documents")
def native_script_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", text.native_script_col(F.coalesce("text", F.lit(""))).alias("native"))


@query("""
    WITH n AS (SELECT c_custkey, regexp_extract(c_name, '[0-9]+') AS n FROM customer)
    SELECT c_custkey, CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END AS number FROM n""")
def canonical_number(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.canonical_number_col(F.regexp_extract("c_name", "[0-9]+", 0)).alias("number"))


@query("""
    WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS t FROM part),
         i AS (SELECT p_partkey, array_to_string(list_transform(t, lambda x: x[1]), '') AS a,
                      array_to_string(list_transform(list_filter(t, lambda x: x NOT IN ('and', 'of', 'et', 'de', 'du', 'des', 'la', 'le', 'les', 'd', 'l')), lambda x: x[1]), '') AS b FROM w)
    SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct([a, b]), lambda x: len(x) >= 2)), '|') AS initials FROM i""")
def initials(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.initials_col(F.lower("p_name")), "|").alias("initials"))


@query()
def fold_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_col("text")).alias("folded_md5"))


@query()
def units_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", text.units_col(text.fold_col("text")).alias("unit"))


@query()
def phonetic_key(spark, d):
    return table(spark, d, "part").select("p_partkey", text.phonetic_col(F.lower("p_name")).alias("phonetic"))


@query()
def clean_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.clean_name_col("s_name").alias("cleaned"))


# Similarity --------------------------------------------------------------------------


@query("WITH n AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b, levenshtein(a.n, b.n) AS dist FROM n a JOIN n b ON a.n < b.n AND split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1)")
def levenshtein_pairs(spark, d):
    n = table(spark, d, "part").select("p_name").distinct()
    a, b = n.select(F.col("p_name").alias("a"), F.split("p_name", " ")[0].alias("k")), n.select(F.col("p_name").alias("b"), F.split("p_name", " ")[0].alias("k"))
    return a.join(b, "k").where("a < b").select("a", "b", F.levenshtein("a", "b").alias("dist"))


@query("WITH n AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b, round(jaro_winkler_similarity(a.n, b.n), 6) AS jw FROM n a JOIN n b ON a.n < b.n AND split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1)")
def jaro_winkler_pairs(spark, d):
    t = levenshtein_pairs(spark, d)
    return t.select("a", "b", _r(similarity.metrics_col(F.col("a"), F.col("b"), ("jaro_winkler",))["jaro_winkler"]).alias("jw"))


@query()
def string_metric_features(spark, d):
    t = levenshtein_pairs(spark, d)
    return t.select("a", "b", similarity.metrics_col(F.col("a"), F.col("b")).alias("x")).select("a", "b", *[_r(F.col(f"x.{m}")).alias(m) for m in similarity.METRICS])


@query("""
    WITH n AS (SELECT DISTINCT p_name AS n, string_split(p_name, ' ') AS t FROM part)
    SELECT a.n AS a, b.n AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM n a JOIN n b ON a.n < b.n AND a.t[1] = b.t[1]""")
def token_jaccard(spark, d):
    t = levenshtein_pairs(spark, d)
    return t.select("a", "b", _r(similarity.jaccard_col(F.split("a", " "), F.split("b", " "))).alias("jaccard"))


@query("""
    WITH w AS (SELECT p_partkey AS id, p_brand AS country, unnest(list_distinct(string_split(p_name, ' '))) AS tok FROM part),
    n AS (SELECT p_brand AS country, count(*) AS n FROM part GROUP BY 1),
    idf AS (SELECT country, tok, ln(max(n) / count(*)) AS idf FROM w JOIN n USING (country) GROUP BY 1, 2),
    pr AS (SELECT a.p_partkey AS s, b.p_partkey AS c, a.p_brand AS country FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
    bs AS (SELECT s, c, country, tok, sum(m) AS m FROM (SELECT s, c, pr.country, tok, 1 AS m FROM pr JOIN w ON w.id = s UNION ALL SELECT s, c, pr.country, tok, 2 AS m FROM pr JOIN w ON w.id = c) GROUP BY 1, 2, 3, 4)
    SELECT s, c, round(sum(CASE WHEN m = 3 THEN idf ELSE 0 END) / sum(idf), 6) AS jacc, round(coalesce(max(CASE WHEN m <> 3 THEN idf END), 0), 6) AS mismatch FROM bs JOIN idf USING (country, tok) GROUP BY 1, 2 HAVING sum(idf) > 0""")
def idf_jaccard(spark, d):
    part = table(spark, d, "part")
    idf = linkage.idf_table(part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("country"), F.col("p_name").alias("name_core")))
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("country"), "p_size", F.coalesce("p_name", F.lit("")).alias("name"))
    out = linkage.idf_overlap_within(rows, "p_size", idf)
    zero = F.col("name_idf_jacc") == 0
    return out.where(~(zero & (F.col("name_rare_mismatch") == 0))).select("s", "c", _r("name_idf_jacc").alias("jacc"), _r("name_rare_mismatch").alias("mismatch"))


# Blocking ----------------------------------------------------------------------------


@query(f"WITH {DOC_TOKENS}, {RARE} SELECT id, country, tok, pos FROM rare")
def rarest_tokens(spark, d):
    return rare_tokens(spark, d).select("id", "country", "tok", "pos")


@query(f"WITH {DOC_TOKENS}, {RARE}, {RARE_PAIRS} SELECT s, c, key_hits FROM hits")
def key_blocks_grouped(spark, d):
    return rare_pairs(spark, d)


@query("""
    WITH k AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS q, p_brand || '|' || p_size || '|' || w AS key FROM part, unnest(string_split(p_name, ' ')) AS u(w)),
    dk AS (SELECT DISTINCT * FROM k), small AS (SELECT key FROM dk GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100)
    SELECT a.id AS s, b.id AS c, count(*) AS key_hits FROM dk a JOIN dk b USING (key) JOIN small USING (key) WHERE a.q AND NOT b.q GROUP BY 1, 2""")
def key_blocks(spark, d):
    part = table(spark, d, "part")
    keys = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).alias("is_query"), F.explode(F.split("p_name", " ")).alias("w"), "p_brand", "p_size")
    return blocking.block_pairs(keys.select("id", "is_query", F.concat_ws("|", "p_brand", "p_size", "w").alias("key")), 100)


@query(f"""
    WITH {DOC_TOKENS}, {RARE}, two AS (SELECT id, is_query, string_agg(tok, '|' ORDER BY tok) AS key FROM rare WHERE pos <= 2 GROUP BY 1, 2 HAVING count(*) = 2),
    small AS (SELECT key FROM two GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100)
    SELECT a.id AS s, b.id AS c, count(*) AS key_hits FROM two a JOIN two b USING (key) JOIN small USING (key) WHERE a.is_query AND NOT b.is_query GROUP BY 1, 2""")
def name_only_candidates(spark, d):
    t = rare_tokens(spark, d).where("pos <= 2").groupBy("id", "is_query").agg(F.array_sort(F.collect_list("tok")).alias("t")).where(F.size("t") == 2)
    return blocking.block_pairs(t.select("id", "is_query", F.array_join("t", "|").alias("key")), 100)


_GRAMS = """
    gram AS (SELECT id, block, unnest(flatten([[substr(pw, CAST(i AS INT), CAST(n AS INT)) for i in range(1, greatest(1, length(pw) - n + 1) + 1)] for n in range(3, greatest(3, least(5, length(pw))) + 1)])) AS term FROM (SELECT id, block, ' ' || lower(w) || ' ' AS pw FROM src, unnest(string_split(txt, ' ')) AS u(w) WHERE w <> '')),
    tf AS (SELECT id, block, term, count(*) AS tf FROM gram GROUP BY 1, 2, 3),
    nn AS (SELECT block, count(*) AS n FROM src GROUP BY 1),
    dfr AS (SELECT block, term, count(*) AS df FROM tf GROUP BY 1, 2),
    raw AS (SELECT id, tf.block, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN dfr USING (block, term) JOIN nn USING (block) WHERE df >= 2 AND df <= 0.5 * n),
    wt AS (SELECT id, block, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id, block)) AS w FROM raw)"""
_PARTS = "src AS (SELECT p_partkey AS id, p_brand AS block, p_name || ' ' || p_type AS txt FROM part)"
_SIMS = "sims AS (SELECT a.id AS s, b.id AS c, sum(a.w * b.w) AS x FROM wt a JOIN wt b USING (block, term) WHERE a.id % 3 = 0 AND b.id % 3 <> 0 GROUP BY 1, 2)"


def part_classes(spark, d) -> tuple[DataFrame, DataFrame]:
    """(members, weights of the classes) of parts with equal texts in a brand."""
    src = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.concat_ws(" ", "p_name", "p_type").alias("txt"))
    members, classes = blocking.text_classes(src)
    return members, blocking.term_weights(classes, blocking.char_ngrams(F.col("txt")), "block", 2, 0.5, "copies")


@query(f"WITH {_PARTS}, {_GRAMS} SELECT id, block, term, round(w, 6) AS w FROM wt")
def tfidf_weights(spark, d):
    members, weights = part_classes(spark, d)
    return members.join(weights.withColumnRenamed("id", "cls"), "cls").select("id", "block", "term", _r("w").alias("w"))


def _top_parts(spark, d, k=20, groups=None) -> DataFrame:
    members, weights = part_classes(spark, d)
    members = members.withColumn("grp", F.lit("")) if groups is None else members.join(groups, "id")
    return blocking.class_topk(weights, members.withColumn("is_query", F.col("id") % 3 == 0), k, 0.1, 5)


@query(f"WITH {_PARTS}, {_GRAMS}, {_SIMS} SELECT s, c, round(x, 5) AS tfidf_sim, row_number() OVER (PARTITION BY s ORDER BY round(x, 5) DESC, c) AS tfidf_rank FROM sims WHERE x > 0.1 QUALIFY tfidf_rank <= 20")
def tfidf_topk(spark, d):
    return _top_parts(spark, d)


@query(f"""
    WITH {_PARTS}, {_GRAMS}, {_SIMS}, g AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size % 5 AS VARCHAR) END AS g FROM part)
    SELECT s, c, round(x, 5) AS tfidf_sim, row_number() OVER (PARTITION BY s ORDER BY round(x, 5) DESC, c) AS tfidf_rank FROM sims JOIN g a ON a.id = s JOIN g b ON b.id = c WHERE x > 0.1 AND (a.g = '' OR b.g = '' OR a.g = b.g) QUALIFY tfidf_rank <= 20""")
def tfidf_topk_grouped(spark, d):
    g = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "").otherwise((F.col("p_size") % 5).cast("string")).alias("grp"))
    return _top_parts(spark, d, groups=g)


@query("""
    WITH pr AS (SELECT cn.n_name AS gs, sn.n_name AS gc FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey),
    sz AS (SELECT gs AS g, count(*) AS n FROM pr GROUP BY 1), cr AS (SELECT least(gs, gc) AS x, greatest(gs, gc) AS y, count(*) AS n FROM pr WHERE gs <> gc GROUP BY 1, 2)
    SELECT x, y, cr.n, coalesce(a.n, cr.n) AS x_size, coalesce(b.n, cr.n) AS y_size FROM cr LEFT JOIN sz a ON a.g = x LEFT JOIN sz b ON b.g = y""")
def state_groups_counts(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    t = t.join(n.toDF("c_nationkey", "gs"), "c_nationkey").join(n.toDF("s_nationkey", "gc"), "s_nationkey")
    return blocking.cross_group_counts(t.select("gs", "gc"))


_CHANNELS = f"{DOC_TOKENS}, {RARE}, {RARE_PAIRS}, {COPIES}, two AS (SELECT s, c FROM hits WHERE key_hits >= 2)"


@query(f"WITH {_CHANNELS} SELECT s, c, coalesce(key_hits, 0) AS key_hits, coalesce(equal, 0) AS equal FROM hits FULL JOIN (SELECT s, c, 1 AS equal FROM copies) e USING (s, c)")
def block_family_union(spark, d):
    return blocking.union_channels(rare_pairs(spark, d), copies(spark, d).withColumn("equal", F.lit(1)), defaults={"key_hits": 0, "equal": 0})


@query(f"""
    WITH {_CHANNELS}, t AS (SELECT c.s, c.c, CASE WHEN h.s IS NULL THEN 0 ELSE 1 END AS a, CASE WHEN two.s IS NULL THEN 0 ELSE 1 END AS b FROM copies c LEFT JOIN hits h ON h.s = c.s AND h.c = c.c LEFT JOIN two ON two.s = c.s AND two.c = c.c)
    SELECT round(avg(a), 6) AS keys_alone, round(avg(b), 6) AS strong_alone, round(avg(greatest(a, b)), 6) AS combined, round(avg(greatest(a, b)) - avg(b), 6) AS keys_marginal, round(avg(greatest(a, b)) - avg(a), 6) AS strong_marginal FROM t""")
def channel_recall_report(spark, d):
    pairs = rare_pairs(spark, d)
    t = blocking.channel_recall(copies(spark, d), {"keys": pairs, "strong": pairs.where("key_hits >= 2")})
    return t.select(*[_r(c).alias(c) for c in t.columns])


@query(f"WITH {CLAIMS} SELECT s, c, qty, count(*) OVER w AS cand_degree, max(p) OVER w AS cand_best_sim, CASE WHEN p >= max(p) OVER w - 1e-6 THEN 1 ELSE 0 END AS is_cand_best FROM claims WINDOW w AS (PARTITION BY c)")
def candidate_context(spark, d):
    return blocking.candidate_context(claims(spark, d), "p").select("s", "c", "qty", "cand_degree", "cand_best_sim", "is_cand_best")


@query(f"WITH {_CHANNELS} SELECT s AS a, c AS b FROM two UNION SELECT c, s FROM two")
def graph_edges(spark, d):
    return blocking.graph_edges(rare_pairs(spark, d).where("key_hits >= 2"))


@query(f"WITH {_CHANNELS}, e AS (SELECT s AS a, c AS b FROM two UNION SELECT c, s FROM two) SELECT h.s, e.b AS c, count(*) AS graph_paths FROM hits h JOIN e ON e.a = h.c GROUP BY 1, 2")
def graph_expand(spark, d):
    pairs = rare_pairs(spark, d)
    return blocking.graph_expand(pairs, blocking.graph_edges(pairs.where("key_hits >= 2")))


_VEC = "q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), sim AS (SELECT q.vec_id AS s, e.vec_id AS c, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS dense_sim, q.label = e.label AS same FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), top AS (SELECT s, c, dense_sim, same, row_number() OVER (PARTITION BY s ORDER BY dense_sim DESC, c) AS dense_rank FROM sim QUALIFY dense_rank <= 30)"


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", F.lit(1).alias("block"))


def _dense(spark, d, k=30) -> DataFrame:
    v = vectors(spark, d)
    t = blocking.dense_topk(v.where("id % 20 = 0"), v, 1 << 30).select("s", "c", _r("dense_sim").alias("dense_sim"))
    return windows.top_n(t, "s", "dense_sim", "c", k, "dense_rank")


def _same_label(spark, d) -> DataFrame:
    v = vectors(spark, d).select("id", "label")
    q = v.where("id % 20 = 0").toDF("s", "label")
    return q.join(v.toDF("c", "label"), "label").where("s <> c").select("s", "c")


@query(f"WITH {_VEC} SELECT s, c, dense_sim, dense_rank FROM top")
def dense_topk(spark, d):
    return _dense(spark, d)


@query(f"WITH {_VEC} SELECT s, c, dense_rank AS found_rank FROM top WHERE same")
def found_rank(spark, d):
    return blocking.found_ranks(_dense(spark, d), _same_label(spark, d), "dense_rank")


@query(f"WITH {_VEC}, t AS (SELECT sim.s, sim.c, dense_rank AS r FROM sim LEFT JOIN top USING (s, c) WHERE sim.same) SELECT round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10, round(avg(CASE WHEN r <= 30 THEN 1.0 ELSE 0 END), 6) AS recall_at_30 FROM t")
def recall_at_k(spark, d):
    t = blocking.recall_at_k(_dense(spark, d), _same_label(spark, d), "dense_rank", (10, 30))
    return t.select(*[_r(c).alias(c) for c in t.columns])


@query()
def dense_topk_lsh(spark, d):
    v = vectors(spark, d)
    return blocking.dense_topk_lsh(v.where("id % 20 = 0"), v, 30)


@query("WITH a AS (SELECT c_name || c_nationkey AS x, c_custkey AS id, c_nationkey || '|' || c_mktsegment AS adr FROM customer), e AS (SELECT adr, min(id) AS s FROM a WHERE id % 3 = 0 GROUP BY 1 HAVING count(*) = 1) SELECT s, id AS c FROM e JOIN a USING (adr) WHERE id % 3 <> 0")
def lone_address_pairs(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("address"))
    return blocking.lone_address_pairs(t.where("id % 3 = 0"), t.where("id % 3 <> 0"))


# Windows ---------------------------------------------------------------------------------

_COMP = "comp AS (SELECT s, c, row_number() OVER w AS crank, qty - CASE WHEN row_number() OVER w = 1 THEN nth_value(qty, 2) OVER f ELSE first_value(qty) OVER f END AS cmargin, count(*) OVER (PARTITION BY c) AS ncomp FROM claims WINDOW w AS (PARTITION BY c ORDER BY qty DESC, s), f AS (PARTITION BY c ORDER BY qty DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query(f"WITH {CLAIMS}, {_COMP} SELECT * FROM comp")
def competition_table(spark, d):
    return windows.competition_table(claims(spark, d), "qty")


@query(f"WITH {CLAIMS}, {_COMP}, o AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 1 AS c FROM lineitem) SELECT o.s, o.c, coalesce(crank, 99) AS crank, cmargin, coalesce(ncomp, 0) AS ncomp FROM o LEFT JOIN comp USING (s, c)")
def competition_lookup(spark, d):
    t = claims(spark, d)
    return windows.competition_lookup(t.select("s", (F.col("c") + 1).alias("c")), windows.competition_table(t, "qty"))


@query("""
    WITH g AS (SELECT l_suppkey AS s, l_partkey AS c, sum(l_quantity) AS a, CASE WHEN max(l_discount) > 0.04 THEN max(l_discount) END AS b FROM lineitem GROUP BY 1, 2)
    SELECT s, c, row_number() OVER wa AS q_crank, count(a) OVER (PARTITION BY c) AS q_ncomp, CASE WHEN b IS NULL THEN 99 ELSE row_number() OVER wb END AS d_crank, CASE WHEN b IS NULL THEN 0 ELSE count(b) OVER (PARTITION BY c) END AS d_ncomp
    FROM g WINDOW wa AS (PARTITION BY c ORDER BY a DESC, s), wb AS (PARTITION BY c ORDER BY b DESC NULLS LAST, s)""")
def competition_multi_signal(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("c")).agg(F.sum("l_quantity").alias("a"), F.max("l_discount").alias("m"))
    t = t.withColumn("b", F.when(F.col("m") > 0.04, F.col("m")))
    return windows.competition_signals(t, {"q_": "a", "d_": "b"}).select("s", "c", "q_crank", "q_ncomp", "d_crank", "d_ncomp")


@query(f"WITH {CLAIMS} SELECT s, c, row_number() OVER (PARTITION BY c ORDER BY p DESC, s) AS a_crank, count(*) OVER w AS a_ncomp, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER w - CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS a_nhi, round(p / greatest(sum(p) OVER w, 1e-6), 12) AS a_share FROM claims WINDOW w AS (PARTITION BY c)")
def model_competition_share(spark, d):
    t = windows.model_competition(claims(spark, d))
    return t.select("s", "c", "a_crank", "a_ncomp", "a_nhi", _r("a_share", 12).alias("a_share"))


@query(f"""
    WITH {CLAIMS}, sure AS (SELECT s, c, qty FROM claims WHERE p >= 0.9), n AS (SELECT s, count(*) AS n FROM sure GROUP BY 1)
    SELECT a.s, a.c, coalesce(n, 0) - CASE WHEN a.p >= 0.9 THEN 1 ELSE 0 END AS s1_nconf, (SELECT max(-abs(a.qty - b.qty)) FROM sure b WHERE b.s = a.s AND b.c <> a.c AND a.p >= 0.01) AS sib_max FROM claims a LEFT JOIN n USING (s)""")
def cluster_support(spark, d):
    return windows.cluster_support(claims(spark, d), -F.abs(F.col("l.qty") - F.col("r.qty"))).select("s", "c", "s1_nconf", "sib_max")


@query("""
    WITH a AS (SELECT s_suppkey AS s, s_nationkey AS adr FROM supplier), b AS (SELECT c_custkey AS c, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey END AS adr FROM customer), n AS (SELECT adr, count(*) AS n FROM a GROUP BY 1)
    SELECT a.s, b.c, n.n AS s1_addr_cnt, CASE WHEN b.adr IS NULL THEN 0 ELSE coalesce(m.n, 0) END AS cand_addr_s1cnt FROM a JOIN n USING (adr) JOIN (SELECT DISTINCT l_suppkey AS s, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey) p ON p.s = a.s JOIN b ON b.c = p.c LEFT JOIN n m ON m.adr = b.adr""")
def address_competition(spark, d):
    pairs = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s"), F.col("o_custkey").alias("c")).distinct()
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("x").alias("country"), F.col("s_nationkey").cast("string").alias("address"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("x").alias("country"), F.when(F.col("c_nationkey") == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("address"))
    return windows.address_counts(pairs, a, b).select("s", "c", "s1_addr_cnt", "cand_addr_s1cnt")


@query(f"""
    WITH {CLAIMS}, r AS (SELECT *, CASE WHEN qty > 30 THEN qty END AS rr FROM claims)
    SELECT s, c, CASE WHEN rr IS NULL THEN 0 ELSE 1 END AS has_rr, CASE WHEN rr IS NULL THEN 99 ELSE row_number() OVER (PARTITION BY s ORDER BY rr DESC NULLS LAST, c) END AS rr_rank, max(rr) OVER w - rr AS rr_gap, row_number() OVER (PARTITION BY s ORDER BY p DESC, c) AS p_rank, round(max(p) OVER w - p, 6) AS p_gap, count(*) OVER w AS n_cands FROM r WINDOW w AS (PARTITION BY s)""")
def stack_features(spark, d):
    t = windows.stack_features(claims(spark, d).withColumn("rr", F.when(F.col("qty") > 30, F.col("qty"))))
    return t.select("s", "c", "has_rr", "rr_rank", "rr_gap", "p_rank", _r("p_gap").alias("p_gap"), "n_cands")


@query(f"WITH {CLAIMS} SELECT s, c, round(max(p) OVER (PARTITION BY s) - p, 6) AS gap, count(*) OVER (PARTITION BY s) AS n FROM claims")
def gap_to_best(spark, d):
    return claims(spark, d).select("s", "c", _r(windows.gap_to_best("p", "s")).alias("gap"), windows.group_size("s").alias("n"))


@query(f"WITH {CLAIMS}, r AS (SELECT c, qty, row_number() OVER (PARTITION BY c ORDER BY qty DESC, s) AS k FROM claims) SELECT claims.s, claims.c, coalesce(r.qty, 0) AS second FROM claims LEFT JOIN r ON r.c = claims.c AND k = 2")
def second_max(spark, d):
    return claims(spark, d).select("s", "c", windows.second_max("qty", "c").alias("second"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def topn_per_group(spark, d):
    return windows.top_n(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query(f"WITH {CLAIMS} SELECT s, c, sum(qty) OVER w AS total, max(qty) OVER w AS top FROM claims WINDOW w AS (PARTITION BY s ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_totals(spark, d):
    return claims(spark, d).select("s", "c", windows.running_total("qty", "s", F.asc("c")).alias("total"), windows.running_max("qty", "s", F.asc("c")).alias("top"))


_EXPECTED = """e AS (SELECT s, c, p * 0.9 AS q FROM claims),
    k AS (SELECT s, c, q, row_number() OVER w AS k, 1.25 * sum(q) OVER r / (0.25 * sum(q) OVER (PARTITION BY s) + row_number() OVER w) AS gain, exp(sum(ln(1 - q)) OVER (PARTITION BY s)) AS none FROM e WINDOW w AS (PARTITION BY s ORDER BY q DESC, c), r AS (PARTITION BY s ORDER BY q DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    best AS (SELECT s, max(gain) AS top FROM k GROUP BY 1), cut AS (SELECT k.s, min(k) AS cut FROM k JOIN best USING (s) WHERE gain >= top - 1e-12 GROUP BY 1)"""


@query(f"WITH {CLAIMS}, {_EXPECTED} SELECT k.s, k.c FROM k JOIN best USING (s) JOIN cut USING (s) WHERE top > none AND k <= cut")
def running_expected_f(spark, d):
    t = claims(spark, d).select("s", "c", (F.col("p") * 0.9).alias("q"))
    return decision.decide_expected(t).select("s", "c")


@query(f"WITH {CLAIMS.replace('FROM lineitem', 'FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)')}, {_COMP} SELECT * FROM comp")
def hidden_owner_competition(spark, d):
    hidden = suppliers(spark, d).where("s % 5 = 0")
    return windows.hidden_competition(claims(spark, d), hidden, "qty")


_EDGES = "e AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"


def part_edges(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return t.select("l_orderkey", F.col("l_partkey").alias("a")).join(t.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").where("a <> b").select("a", "b").distinct()


@query(f"""
    WITH {CLAIMS}, {_EDGES}, sup AS (SELECT x.s, e.b AS c, max(x.p) AS m, avg(x.p) AS av, count(*) AS n, sum(CASE WHEN x.p >= 0.7 THEN 1 ELSE 0 END) AS n70 FROM claims x JOIN e ON e.a = x.c WHERE x.p >= 0.3 GROUP BY 1, 2)
    SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY p DESC, c) AS rank_p, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER w AS n_ge50, count(*) OVER w AS n_cands, coalesce(m, 0) AS sup_max, round(coalesce(av, 0), 9) AS sup_mean, coalesce(n, 0) AS sup_deg, coalesce(n70, 0) AS sup_n70 FROM claims LEFT JOIN sup USING (s, c) WINDOW w AS (PARTITION BY s)""")
def duplicate_support(spark, d):
    parts = group_lists(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", Scratch(spark, "duplicate-support"))
    t = windows.second_stage_features(claims(spark, d, by_supplier=True).select("s", "c", "p"), parts, only=["rank_p", "n_ge50", "n_cands"])
    return t.select("s", "c", "rank_p", "n_ge50", "n_cands", "sup_max", _r("sup_mean", 9).alias("sup_mean"), "sup_deg", "sup_n70")


@query(f"""
    WITH {CLAIMS}, {_EDGES}, best AS (SELECT c AS b, max(p) AS best FROM claims GROUP BY 1), want AS (SELECT s, c AS b FROM claims WHERE p >= 0.5)
    SELECT x.s, x.c, count(*) AS n_nb, sum(CASE WHEN w.s IS NULL THEN 0 ELSE 1 END) AS n_same, sum(CASE WHEN coalesce(best, 0) < 0.1 THEN 1 ELSE 0 END) AS n_orphan, sum(CASE WHEN coalesce(best, 0) >= 0.5 AND w.s IS NULL THEN 1 ELSE 0 END) AS n_owned
    FROM claims x JOIN e ON e.a = x.c LEFT JOIN best ON best.b = e.b LEFT JOIN want w ON w.s = x.s AND w.b = e.b GROUP BY 1, 2""")
def orphan_features(spark, d):
    return windows.orphan_features(claims(spark, d), part_edges(spark, d))


# Decision and evaluation ------------------------------------------------------------------


@query(f"WITH {CLAIMS}, {DECIDED} SELECT s, c FROM pred")
def decide_one_owner(spark, d):
    return predicted(spark, d)


@query(f"{JUDGED} SELECT round(avg({F05}), 6) AS macro_f05 FROM cnt")
def macro_f05(spark, d):
    return decision.macro_f05(predicted(spark, d), owned(spark, d), suppliers(spark, d)).select(_r("macro_f05").alias("macro_f05"))


@query(f"{JUDGED} SELECT nation, round(avg({F05}), 6) AS macro_f05, count(*) AS n FROM cnt GROUP BY 1")
def f05_breakdown(spark, d):
    return decision.f05_breakdown(predicted(spark, d), owned(spark, d), suppliers(spark, d), "nation").select("nation", _r("macro_f05").alias("macro_f05"), "n")


@query(f"{JUDGED} SELECT round(avg({F05}), 6) AS macro_f05, round(avg(CASE WHEN n_true = 0 THEN {F05} END), 6) AS singletons, round(avg(CASE WHEN n_true > 0 THEN {F05} END), 6) AS non_singletons FROM cnt")
def evaluate_matches(spark, d):
    t = decision.evaluate(predicted(spark, d), owned(spark, d), suppliers(spark, d))
    return t.select(*[_r(c).alias(c) for c in t.columns])


@query(f"WITH {CLAIMS}, {OWNED}, {DECIDED} SELECT round(avg(CASE WHEN pred.s IS NULL THEN 0.0 ELSE 1.0 END), 6) AS completeness FROM truth LEFT JOIN pred ON pred.s = truth.s AND pred.c = truth.c")
def pair_completeness(spark, d):
    return decision.pair_completeness(predicted(spark, d), owned(spark, d)).select(_r("completeness").alias("completeness"))


@query("WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max FROM n")
def candidates_per_entity(spark, d):
    t = decision.candidates_per_entity(table(spark, d, "orders").select(F.col("o_custkey").alias("s")), table(spark, d, "customer").select(F.col("c_custkey").alias("s")))
    return t.select(_r("mean").alias("mean"), _r("p95").alias("p95"), "max")


_TAUS = [round(0.05 * i, 2) for i in range(1, 20)]


@query(f"""
    WITH {CLAIMS}, {OWNED}, {SUPPLIERS}, own AS (SELECT s, c, p FROM claims QUALIFY row_number() OVER (PARTITION BY c ORDER BY p DESC, s) = 1), g AS (SELECT unnest([{", ".join(map(str, _TAUS))}]::DOUBLE[]) AS tau),
    k AS (SELECT tau, own.s, count(*) AS n_pred, count(truth.c) AS tp FROM g JOIN own ON p >= tau LEFT JOIN truth ON truth.s = own.s AND truth.c = own.c GROUP BY 1, 2),
    cnt AS (SELECT g.tau, ent.s, coalesce(k.n_pred, 0) AS n_pred, coalesce(k.tp, 0) AS tp, coalesce(t.n, 0) AS n_true FROM g CROSS JOIN ent LEFT JOIN k ON k.tau = g.tau AND k.s = ent.s LEFT JOIN (SELECT s, count(*) AS n FROM truth GROUP BY 1) t ON t.s = ent.s)
    SELECT tau, round(avg({F05}), 6) AS macro_f05 FROM cnt GROUP BY 1""")
def threshold_grid(spark, d):
    return decision.threshold_grid(claims(spark, d), owned(spark, d), suppliers(spark, d), _TAUS).select("tau", _r("macro_f05").alias("macro_f05"))


@query(f"WITH {CLAIMS}, r AS (SELECT claims.s, c, least(1.0, p * 0.75 / CASE WHEN n_name = 'FRANCE' THEN 0.9 WHEN n_name = 'GERMANY' THEN 0.6 ELSE 0.75 END) AS p FROM claims JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey) SELECT s, c FROM r WHERE p >= 0.75 QUALIFY row_number() OVER (PARTITION BY c ORDER BY p DESC, s) = 1")
def country_threshold(spark, d):
    n = suppliers(spark, d).join(table(spark, d, "nation"), F.col("nation") == F.col("n_nationkey")).select("s", F.col("n_name").alias("country"))
    return decision.decide(decision.rescale_by_country(claims(spark, d).join(n, "s"), {"FRANCE": 0.9, "GERMANY": 0.6}, 0.75), 0.75).select("s", "c")


@query(f"WITH {CLAIMS} SELECT s, string_agg(CAST(c AS VARCHAR), ',' ORDER BY CAST(c AS VARCHAR)) AS candidate_entity_ids FROM claims WHERE p >= 0.3 GROUP BY 1")
def learned_filter(spark, d):
    kept = claims(spark, d).where("p >= 0.3").select("s", F.col("c").cast("string").alias("c"))
    return tables.collect_lists(kept.select("s").distinct(), kept, "candidate_entity_ids")


@query(f"{JUDGED} SELECT round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END), 6) AS oracle_f05 FROM cnt")
def oracle_f05(spark, d):
    return decision.oracle_f05(predicted(spark, d), owned(spark, d), suppliers(spark, d)).select(_r("oracle_f05").alias("oracle_f05"))


@query(f"{JUDGED} SELECT round(avg({F05}), 6) AS as_is, round(avg({F05.replace('n_pred', 'tp')}), 6) AS no_wrong, round(avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END ELSE 1.25 * n_true / (0.25 * n_true + n_pred - tp + n_true) END), 6) AS no_missed, 1.0 AS perfect FROM cnt")
def what_if_f05(spark, d):
    t = decision.what_if(predicted(spark, d), owned(spark, d), suppliers(spark, d))
    return t.select(*[_r(c).alias(c) for c in t.columns])


@query(f"""
    WITH {CLAIMS}, {OWNED}, {DECIDED}, own AS (SELECT c, max(s) AS o FROM pred GROUP BY 1)
    SELECT truth.s, truth.c, CASE WHEN claims.p < 0.6 THEN 'below_threshold' WHEN o <> truth.s THEN 'other_owner' ELSE 'other' END AS cause FROM truth JOIN claims USING (s, c) LEFT JOIN own USING (c) LEFT JOIN pred ON pred.s = truth.s AND pred.c = truth.c WHERE pred.s IS NULL""")
def miss_causes(spark, d):
    pred = predicted(spark, d)
    missed = owned(spark, d).join(pred, ["s", "c"], "left_anti").join(claims(spark, d), ["s", "c"]).join(pred.select(F.col("s").alias("o"), "c"), "c", "left")
    cause = decision.first_cause({"below_threshold": F.col("p") < 0.6, "other_owner": F.col("o") != F.col("s")})
    return missed.select("s", "c", cause.alias("cause"))


@query("""
    WITH t AS (SELECT n_chars AS p, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM t)
    SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def auc_rank_sum(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("n_chars").alias("p"), F.col("quality").alias("label"))
    return decision.auc(t).select(_r("auc").alias("auc"))


@query("""
    WITH a AS (SELECT o_totalprice AS x FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_totalprice AS x FROM orders WHERE o_orderstatus <> 'O'),
    e AS (SELECT unnest(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM a),
    s AS (SELECT k, bin, count(*) / sum(count(*)) OVER (PARTITION BY k) AS sh FROM (SELECT 'a' AS k, (SELECT count(*) FROM e WHERE e < x) AS bin FROM a UNION ALL SELECT 'b', (SELECT count(*) FROM e WHERE e < x) FROM b) GROUP BY 1, 2),
    j AS (SELECT greatest(coalesce(p.sh, 0), 1e-4) AS pa, greatest(coalesce(q.sh, 0), 1e-4) AS pb FROM (SELECT * FROM s WHERE k = 'a') p FULL JOIN (SELECT * FROM s WHERE k = 'b') q USING (bin))
    SELECT round(sum((pb - pa) * ln(pb / pa)), 6) AS psi FROM j""")
def psi_drift(spark, d):
    t = table(spark, d, "orders")
    return decision.psi(t.where("o_orderstatus = 'O'"), t.where("o_orderstatus <> 'O'"), "o_totalprice").select(_r("psi").alias("psi"))


@query("""
    WITH t AS (SELECT lang, avg(toxic) AS a FROM documents JOIN labels USING (doc_id) GROUP BY 1), b AS (SELECT a FROM t WHERE lang = 'en')
    SELECT lang, round(0.75 / (0.75 + 0.25 * (t.a / (1 - t.a)) / (b.a / (1 - b.a))), 6) AS tau FROM t, b""")
def label_shift_tau(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.avg("toxic").alias("a"))
    base = t.where("lang = 'en'").select(F.col("a").alias("b"))
    return t.crossJoin(F.broadcast(base)).select("lang", _r(decision.label_shift_tau(F.col("b"), F.col("a"))).alias("tau"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS l_discount, round(sum(l_quantity * l_tax) / sum(l_quantity), 6) AS l_tax FROM lineitem GROUP BY 1")
def weighted_mean_rates(spark, d):
    t = decision.weighted_means(table(spark, d, "lineitem"), "l_quantity", ["l_discount", "l_tax"], ["l_returnflag"])
    return t.select("l_returnflag", _r("l_discount").alias("l_discount"), _r("l_tax").alias("l_tax"))


@query("SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), ())")
def rollup_all_country(spark, d):
    t = table(spark, d, "documents").rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("m"), F.grouping("lang").alias("g"))
    return t.select(F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce("lang", F.lit("ALL"))).alias("lang"), "n", _r("m").alias("mean_chars"))


@query("""
    SELECT round(corr(x, y), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM (SELECT source, max(n_chars) AS a, sum(n_chars) AS b FROM documents GROUP BY 1))""")
def spearman_by_source(spark, d):
    t = table(spark, d, "documents").groupBy("source").agg(F.max("n_chars").alias("a"), F.sum("n_chars").alias("b"))
    return decision.rank_correlation(t, "a", "b").select(_r("spearman").alias("spearman"))


@query(f"""
    WITH {CLAIMS}, f AS (SELECT s % 5 AS fold, tau, sum(CASE WHEN (p >= tau) = (t.s IS NOT NULL) THEN 1 ELSE 0 END) AS score FROM claims JOIN (SELECT unnest([0.3, 0.5, 0.7]) AS tau) g ON true LEFT JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS c FROM lineitem WHERE l_quantity >= 48) t USING (s, c) GROUP BY 1, 2),
    r AS (SELECT fold, CAST(tau AS DOUBLE) AS tau, score, sum(score) OVER (PARTITION BY tau) - score AS rest FROM f) SELECT fold, tau, score FROM r QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rest DESC, tau) = 1""")
def nested_thresholds(spark, d):
    t = claims(spark, d).join(owned(spark, d).withColumn("t", F.lit(True)), ["s", "c"], "left").select("*", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))).alias("tau"))
    hit = ((F.col("p") >= F.col("tau")) == F.coalesce("t", F.lit(False))).cast("int")
    return decision.nested_thresholds(t.groupBy((F.col("s") % 5).alias("fold"), "tau").agg(F.sum(hit).alias("score")))


# Aggregation shapes -------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("SELECT o_orderpriority, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def value_shares(spark, d):
    t = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    total = t.agg(F.sum("n").alias("all"))
    return t.crossJoin(F.broadcast(total)).select("o_orderpriority", _r(F.col("n") / F.col("all")).alias("share"))


@query("SELECT CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 2000 THEN '<2000' ELSE '>=2000' END AS bin, count(*) AS n, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def binned_stats(spark, d):
    b = F.when(F.col("n_chars") < 500, "<500").when(F.col("n_chars") < 2000, "<2000").otherwise(">=2000")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg("quality")).alias("quality"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY 1")
def argmax_per_group(spark, d):
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"), F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def quantiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[_r(F.percentile("value", F.lit(q))).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95))])


@query("SELECT tok, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS tok FROM documents) WHERE tok <> '' GROUP BY 1")
def document_frequency(spark, d):
    return doc_tokens(spark, d).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def singletons_except(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT DISTINCT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_filter(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(returned, "p_partkey", "left_semi")


# Sampling -------------------------------------------------------------------------------------


@query("""
    WITH e AS (SELECT c_custkey AS s, c_mktsegment AS country, count(o_orderkey) AS n_matches FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    b AS (SELECT *, CASE WHEN n_matches = 0 THEN '0' WHEN n_matches = 1 THEN '1' WHEN n_matches <= 3 THEN '2-3' WHEN n_matches <= 5 THEN '4-5' ELSE '6+' END AS b FROM e),
    i AS (SELECT *, row_number() OVER (PARTITION BY country, b ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY country, b) AS n FROM b),
    c AS (SELECT *, round_even(n * 0.35, 0) AS t, round_even(n * 0.05, 0) AS v FROM i)
    SELECT s, country, n_matches, CASE WHEN i < t THEN 'A_train' WHEN i < t + v THEN 'A_val' ELSE 'B' END AS split, CASE WHEN i < t + v THEN -1 ELSE CAST((i - t - v) % 5 AS INT) END AS fold FROM c""")
def assign_splits(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s")).agg(F.count("o_orderkey").alias("n"))
    # a customer's repeated rows are one entity, each of them meets all its orders
    e = table(spark, d, "customer").groupBy(F.col("c_custkey").alias("s"), F.col("c_mktsegment").alias("country")).agg(F.count(F.lit(1)).alias("k")).join(n, "s", "left")
    return sampling.assign_splits(e.select("s", "country", (F.col("k") * F.coalesce("n", F.lit(0))).alias("n_matches")), order=(F.asc_nulls_last("s"),))


@query(f"WITH {CLAIMS}, {OWNED} SELECT s, c FROM claims WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s = claims.s AND t.c = claims.c)")
def hard_negatives(spark, d):
    return sampling.hard_negatives(claims(spark, d), owned(spark, d), suppliers(spark, d))


@query(f"""
    WITH {COPIES}, {DOC_ENTITIES}, q AS (SELECT DISTINCT s FROM copies), docs AS (SELECT DISTINCT c FROM copies),
    pool AS (SELECT doc_id AS id, lang AS country, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT c FROM docs) AND lang IN (SELECT country FROM docs1 JOIN q USING (s)))
    SELECT s AS id, 'query' AS role, country FROM docs1 JOIN q USING (s) UNION ALL SELECT doc_id, 'doc', lang FROM documents JOIN docs ON c = doc_id UNION ALL SELECT id, 'doc', country FROM pool WHERE r <= 50""")
def eval_set(spark, d):
    r = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), (F.col("doc_id") % 3 == 0).alias("is_query"))
    return sampling.eval_set(doc_entities(spark, d), copies(spark, d), r, 50, F.col("id"))


@query("""
    SELECT lang, round(avg(CASE WHEN upper(text) = text AND regexp_matches(text, '[A-Z]') THEN 1 ELSE 0 END), 6) AS upper, round(avg(CASE WHEN regexp_matches(text, '[À-ÖØ-öø-ÿ]') THEN 1 ELSE 0 END), 6) AS accent, round(avg(CASE WHEN regexp_matches(text, '(^|[^0-9])[0-9]{5}([^0-9]|$)') THEN 1 ELSE 0 END), 6) AS postal,
           round(avg(CASE WHEN contains(text, '(') THEN 1 ELSE 0 END), 6) AS bracket, round(avg(CASE WHEN text = '' OR lower(text) = 'null' THEN 1 ELSE 0 END), 6) AS "null" FROM (SELECT lang, coalesce(text, '') AS text FROM documents) GROUP BY 1""")
def surface_shares(spark, d):
    return sampling.surface_shares(table(spark, d, "documents"), "text", "lang")


@query(f"""
    WITH {COPIES}, {DOC_ENTITIES}, m AS (SELECT s, count(*) FILTER (c % 3 = 1) AS n2, count(*) FILTER (c % 3 = 2) AS n3 FROM copies GROUP BY 1)
    SELECT country, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, count(*) AS n FROM docs1 LEFT JOIN m USING (s) GROUP BY 1, 2, 3""")
def match_histogram(spark, d):
    r = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 + 1).alias("source"), F.col("lang").alias("country"))
    return sampling.match_histogram(copies(spark, d), r)


@query(f"""
    WITH {CLAIMS}, {OWNED}, l AS (SELECT claims.*, CASE WHEN truth.s IS NULL THEN 0 ELSE 1 END AS label, CASE WHEN p_size <= 20 THEN 'small' ELSE 'large' END AS kind FROM claims LEFT JOIN truth USING (s, c) JOIN part ON p_partkey = c)
    SELECT s, c, 1 AS label, unnest(CASE WHEN p < 0.5 THEN [1, 2] ELSE [1] END) AS copy FROM l WHERE label = 1 UNION ALL
    SELECT s, c, 0, 1 FROM (SELECT *, row_number() OVER (PARTITION BY s, kind ORDER BY p DESC, c) AS r FROM l WHERE label = 0) WHERE r <= CASE WHEN kind = 'small' THEN 4 ELSE 2 END""")
def reranker_pairs(spark, d):
    t = claims(spark, d).join(owned(spark, d).withColumn("label", F.lit(1)), ["s", "c"], "left").fillna(0, ["label"])
    t = t.join(table(spark, d, "part"), F.col("p_partkey") == F.col("c")).withColumn("kind", F.when(F.col("p_size") <= 20, "small").otherwise("large"))
    return sampling.rerank_pairs(t, {"small": 4, "large": 2})


# Queries that SQL does not express; tests hold them against plain versions -------------------------


def raw_records(spark, d) -> DataFrame:
    """Customers as source 1 and suppliers as sources 2 and 3, with made addresses."""
    n = table(spark, d, "nation").select("n_nationkey", F.initcap("n_name").alias("country"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), F.col("c_name").alias("business_name"), F.concat_ws(", ", F.concat(F.col("c_custkey") % 90 + 1, F.lit(" "), "c_mktsegment", F.lit(" rd")), "country").alias("business_address"), "country", F.lit(1).cast("byte").alias("source"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S2-"), "s_suppkey").alias("entity_id"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("business_name"), F.concat_ws(", ", F.concat(F.col("s_suppkey") % 90 + 1, F.lit(" BUILDING road")), "country").alias("business_address"), "country", (F.col("s_suppkey") % 2 + 2).cast("byte").alias("source"))
    return c.unionByName(s)


@query()
def build_records(spark, d):
    return linkage.build_records(raw_records(spark, d))


@query()
def pair_features_48(spark, d):
    held = Scratch(spark, "pair_features")  # each step reads written tables, so no plan holds the text rules of another
    raw = raw_records(spark, d).repartition(4 * spark.sparkContext.defaultParallelism, "entity_id")  # small files, dear rules: else a task or two do all
    r = held.put("records", linkage.build_records(raw))
    names, texts = (held.put(k, v) for k, v in zip(("names", "texts"), linkage.record_vectors(r), strict=True))
    pairs = held.put("pairs", linkage.extra_channels(held.put("family", linkage.block_family(r, keep=held.put)), r, names, texts, keep=held.put))
    return linkage.pair_features(pairs, r)


def label_features(spark, d) -> DataFrame:
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    words = F.split("text", r"\s+")
    return t.select("doc_id", F.col("quality").alias("label"), (F.col("doc_id") % 5).alias("fold"), F.col("n_chars").cast("double").alias("n_chars"), F.size(words).cast("double").alias("n_words"), (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"), (F.length(F.regexp_replace("text", "[A-Za-z ]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("odd_share"))


_FEATURES = ["n_chars", "n_words", "distinct_share", "odd_share"]


@query()
def oof_gbt(spark, d):
    return models.train_oof(label_features(spark, d), _FEATURES)[0].select("doc_id", "label", "fold", _r("p").alias("p"))


@query()
def calibrate_isotonic(spark, d):
    t = models.train_oof(label_features(spark, d), _FEATURES, folds=5, maxIter=5)[0].select("doc_id", "label", "p")
    return models.isotonic(t, t)


@query()
def kmeans_lift(spark, d):
    k = models.spherical_clusters(vectors(spark, d), 10)
    tokens = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("label"), "label").alias("tok"))
    return models.cluster_labels(k, tokens)


@query()
def mc_expected_f(spark, d):
    return decision.expected_f_simulated(claims(spark, d).select("s", "c", (F.col("p") * 0.9).alias("q")))


@query()
def sample_triplets(spark, d):
    truth = copies(spark, d).join(doc_entities(spark, d), "s")
    pool = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"))
    pool = pool.withColumn("k", F.row_number().over(Window.partitionBy("country").orderBy("id")) - 1)
    return sampling.sample_triplets(truth, rare_pairs(spark, d).join(copies(spark, d), ["s", "c"], "left_anti"), pool)


def clean_entities(spark, d) -> DataFrame:
    return raw_records(spark, d).where("source = 1").select(F.col("entity_id").alias("id"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")


@query()
def noise_augment(spark, d):
    return sampling.augment_records(clean_entities(spark, d))


@query()
def proxy_build(spark, d):
    e = clean_entities(spark, d)
    cells = e.select("country").distinct().select("country", F.explode(F.array(*[F.struct(F.lit(a).alias("n2"), F.lit(b).alias("n3"), F.lit(n).alias("n")) for a, b, n in ((0, 0, 6), (1, 0, 24), (1, 1, 40), (2, 1, 30))])).alias("x")).select("country", "x.*")
    return sampling.proxy_family(e, cells, {"name": {"typo": 0.3, "case": 0.5}, "address": {"null_token": 0.1, "abbrev": 0.4}})[0]


@query()
def proxy_measure(spark, d):
    e = clean_entities(spark, d)
    noisy = sampling.augment_records(e).select("id", F.col("name").alias("b"))
    return noise.noise_rates(e.join(noisy, "id"), "name", "b", ["country"])


@query()
def score_uncertain_pairs(spark, d):
    t = levenshtein_pairs(spark, d).withColumn("p", F.col("dist") / 20.0)
    return models.score_pairs(t, models.surrogate_scorer, "a", "b").select("a", "b", "p", _r("rr").alias("rr"))
