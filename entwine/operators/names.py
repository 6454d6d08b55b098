"""Further rules on names: spelling correction, aligned cosines, acronym features, cleaned-name competition, French keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.functions import similarity, text
from entwine.functions.lexicon import load_lexicon
from entwine.operators import blocking, windows


def _deletions(word: Column, size: Column) -> Column:
    """The word without any one letter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))


def correct_words(tokens: DataFrame, vocabulary: DataFrame, min_len: int = 4, rare: int = 3, long: int = 8) -> DataFrame:
    """(country, tok, fixed) for rare words that a frequent word of the vocabulary resembles.

    Tokens and vocabulary have country and tok; the vocabulary also ``freq``.  A word
    of under ``long`` letters may be one edit away, a longer one two; the most
    frequent neighbour wins, ties by the word.  Neighbours share the word, or a form
    with up to two letters deleted, so they meet in a join instead of in pairs.
    """
    words = tokens.select("country", "tok").where((F.length("tok") >= min_len) & ~F.col("tok").rlike("^[0-9]+$")).distinct()
    words = words.join(vocabulary.select("country", "tok", "freq"), ["country", "tok"], "left").where(F.coalesce("freq", F.lit(0)) < rare).drop("freq")
    keep = vocabulary.where((F.length("tok") >= min_len - 1) & (F.col("freq") >= rare))

    def forms(df: DataFrame, name: str, *extra: str) -> DataFrame:
        one = df.withColumn("__d", F.array_distinct(F.concat(F.array("tok"), _deletions(F.col("tok"), F.length("tok")))))
        two = F.array_distinct(F.flatten(F.transform("__d", lambda d: F.concat(F.array(d), F.when(F.length("tok") >= long - 2, _deletions(d, F.length(d))).otherwise(F.array(d))))))
        return one.select("country", F.col("tok").alias(name), *extra, F.explode(two).alias("form")).distinct()

    near = forms(words, "w").join(forms(keep, "v", "freq"), ["country", "form"]).select("country", "w", "v", "freq").distinct()
    limit = F.when(F.length("w") < long, 1).otherwise(2)
    near = near.where((F.levenshtein("w", "v") <= limit) & (F.col("w") != F.col("v")))
    rank = F.row_number().over(Window.partitionBy("country", "w").orderBy(F.desc("freq"), "v"))
    return near.withColumn("__r", rank).where("__r = 1").select("country", F.col("w").alias("tok"), F.col("v").alias("fixed"))


def aligned_cosine(pairs: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """Cosine of the TF-IDF vectors of given pairs (s, c); weights have id, term and w."""
    left = pairs.join(weights.select(F.col("id").alias("s"), "term", F.col("w").alias("ws")), "s")
    both = left.join(weights.select(F.col("id").alias("c"), "term", F.col("w").alias("wc")), ["c", "term"])
    dots = both.groupBy("s", "c").agg(F.sum(F.col("ws") * F.col("wc")).alias(name))
    return pairs.join(dots, ["s", "c"], "left").fillna(0.0, [name])


def name_cosines(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``name_cos`` and ``addr_cos`` by three- and four-grams. Records have id, country, name, address."""
    out = pairs
    for column, name in (("name", "name_cos"), ("address", "addr_cos")):
        w = blocking.term_weights(records, blocking.char_ngrams(F.col(column), 3, 4), "country")
        out = out.join(aligned_cosine(pairs.select("s", "c"), w, name), ["s", "c"])
    return out


def acronym_features(df: DataFrame, s_core: str, c_raw: str) -> DataFrame:
    """Whether the candidate's name is an acronym, equals the entity's initials, or shares a part with them."""
    a, first = text.acronym_col(F.coalesce(c_raw, F.lit(""))), text.initials_col(F.coalesce(s_core, F.lit("")))
    flag = lambda c: ((F.col("__a") != "") & c).cast("int")
    part = F.exists("__i", lambda x: x.contains(F.col("__a")) | F.col("__a").contains(x))
    t = df.withColumns({"__a": a, "__i": first})
    return t.withColumns({"acr_cand": flag(F.lit(True)), "acr_match": flag(F.array_contains("__i", F.col("__a"))), "acr_part": flag(part)}).drop("__a", "__i")


def cleaned_competition(pairs: DataFrame, s_names: DataFrame, c_names: DataFrame) -> DataFrame:
    """Similarity of cleaned names, its competition around the candidate, and how many entities share the name.

    Name tables have id, country and the raw name.
    """
    clean = lambda df, k: df.select(F.col("id").alias(k), F.col("country").alias(f"{k}_country"), text.clean_name_col(F.col("name")).alias(f"{k}_cn"))
    s, c = clean(s_names, "s"), clean(c_names, "c")
    count = s.groupBy("s_country", "s_cn").agg(F.count(F.lit(1)).alias("cn_s1cnt"))
    t = pairs.join(s.join(count, ["s_country", "s_cn"]), "s").join(c, "c")
    m = similarity.metrics_col(F.col("s_cn"), F.col("c_cn"), ("ratio", "token_set", "jaro_winkler"))
    t = t.withColumn("__m", m).select(
        *pairs.columns, (F.col("s_cn") == F.col("c_cn")).cast("int").alias("cn_exact"), F.col("__m.ratio").alias("cn_ratio"), F.col("__m.token_set").alias("cn_tset"), F.col("__m.jaro_winkler").alias("cn_jw"), "cn_s1cnt"
    )
    t = t.withColumn("cn_sim", (F.col("cn_ratio") / 100 + F.col("cn_tset") / 100 + F.col("cn_jw")) / 3)
    return t.join(windows.competition_table(t, "cn_sim", prefix="cn_"), ["s", "c"])


def french_name_key(folded: Column, stopwords: tuple[str, ...] = tuple(sorted(load_lexicon().stopwords))) -> Column:
    """Sorted words of a folded name without stopwords."""
    words = F.filter(F.split(F.regexp_replace(folded, "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(list(stopwords)))
    return F.array_join(F.array_sort(words), " ")


def french_address_key(folded: Column) -> Column:
    """House number and the first three street words of a folded address; empty without a number."""
    number = F.regexp_extract(folded, "[0-9]+", 0)
    words = F.filter(F.split(F.regexp_replace(F.element_at(F.split(folded, ","), 1), "[^a-z]+", " "), " "), lambda w: w != "")
    return F.when(number == "", "").otherwise(F.concat_ws("|", number, F.array_join(F.slice(words, 1, 3), " ")))
