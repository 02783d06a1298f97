"""Language attribution of segments by script and character n-grams, pooled by scope.

Han characters are Chinese with confidence 1. The rest of a segment is classified by itself if it has at least LONG letters,
else it joins its scope's pool, which is classified once. Under FLOOR nobody gets the letters; they stay in the denominator.
The classifier is a naive Bayes over trigrams, trained with aggregates on a bounded labelled sample; texts are scored where
they are. Null or empty text attributes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from glosswork.functions.text import han, is_cjk_other, letters, not_han, words
from glosswork.session import cut_lineage

LONG, FLOOR, GRAM = 12, 0.80, 3
#: bound of the classifier's labelled sample: documents a language, characters of each
MODEL_DOCUMENTS, MODEL_CHARACTERS = 2000, 5000


def grams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gram, n: trigrams of the words of each row's text with their borders. Words are counted before they are cut up,
    so a long text costs its distinct words."""
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")
    words_ = rows.select(*keys, word).filter("w <> ''").groupBy(*keys, "w").agg(F.count("*").alias("n"))
    cut = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(F.concat(F.lit(" "), "w", F.lit(" ")), i, F.lit(GRAM)))
    return words_.select(*keys, "n", F.explode(cut).alias("gram")).groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, least: int = 2, documents: int = MODEL_DOCUMENTS, characters: int = MODEL_CHARACTERS) -> DataFrame:
    """Model (gram, lang, logp) from rows lang, text: the classifier's labelled sample is bounded by `documents` a language (in
    the order of a hash of their text, ranked in every partition before the shuffle) and `characters` of each. Grams seen fewer
    than `least` times carry no weight of their own. The row of gram "" holds a language's log probability of an unseen gram."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = labelled.filter(F.col("text").isNotNull()).select("lang", F.substring("text", 1, characters).alias("text"))
    counts = grams(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= documents), ["lang"]).filter(F.col("n") >= least)
    total = counts.groupBy("lang").agg((F.sum("n") + F.count("*") + 1).alias("total"))
    seen = counts.join(F.broadcast(total), "lang").select("gram", "lang", F.log((F.col("n") + 1) / F.col("total")).alias("logp"))  # a row a language
    return cut_lineage(seen.unionByName(total.select(F.lit("").alias("gram"), "lang", F.log(1 / F.col("total")).alias("logp"))))


def scorer(model: DataFrame) -> Callable[[Column], Column]:
    """Column of texts -> struct<lang, confidence>: the most probable language (softmax over the model's languages), null under
    FLOOR. The model goes to the workers whole: its sample bounds it. A word's score is computed once a worker; no text moves."""
    rows = model.collect()  # at most MODEL_DOCUMENTS * MODEL_CHARACTERS grams a language
    langs = sorted({r["lang"] for r in rows})
    low = np.array([next(r["logp"] for r in rows if r["gram"] == "" and r["lang"] == lang) for lang in langs])
    gains: dict[str, np.ndarray] = {}
    for r in rows:
        if r["gram"]:
            k = langs.index(r["lang"])
            gains.setdefault(r["gram"], np.zeros(len(langs)))[k] = r["logp"] - low[k]
    shared = model.sparkSession.sparkContext.broadcast((langs, low, gains))

    @pandas_udf("struct<lang:string,confidence:double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        import regex

        langs, low, gains = shared.value
        known: dict[str, np.ndarray] = {}
        none = np.zeros(len(langs))
        out = []
        for text in texts:
            score, words_ = np.zeros(len(langs)), [w for w in regex.split(r"[^\p{L}]+", (text or "").lower()) if w]
            for w in words_ if langs else ():
                got = known.get(w)
                if got is None:
                    padded = f" {w} "
                    got = known[w] = len(w) * low + sum((gains.get(padded[i : i + GRAM], none) for i in range(len(w))), none)
                score = score + got
            if not words_ or not langs:
                out.append((None, None))
                continue
            p = np.exp(score - score.max())
            k = max(range(len(langs)), key=lambda i: (p[i], langs[i]))
            sure = float(p[k] / p.sum())
            out.append((langs[k] if sure >= FLOOR else None, sure))
        return pd.DataFrame(out, columns=["lang", "confidence"])

    return run


def classify(texts: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """key, lang, confidence of each row's text."""
    return texts.select(*key, scorer(model)(F.col("text")).alias("c")).select(*key, "c.lang", "c.confidence")


def tallies(segments: DataFrame, scope: list[str], model: DataFrame) -> DataFrame:
    """scope, language (null: unattributed), characters, words, confidence: the profile of each scope."""
    rows = segments.filter(F.col("text").isNotNull()).select(*scope, "seg_index", "seg_id", "text")
    han_rows = rows.groupBy(*scope).agg(F.sum(F.length(han(F.col("text")))).alias("characters")).filter("characters > 0")
    zh = han_rows.select(*scope, F.lit("zh").alias("language"), "characters", F.lit(None).cast("bigint").alias("words"), F.lit(1.0).alias("confidence"))
    other = rows.select(*scope, "seg_index", "seg_id", not_han(F.col("text")).alias("text")).withColumn("n", F.length(letters(F.col("text")))).filter("n > 0")
    alone = other.filter(F.col("n") >= LONG).select(*scope, F.col("seg_id").cast("string").alias("part"), "text", "n")
    ordered = F.array_sort(F.collect_list(F.struct("seg_index", "seg_id", "text")))
    pool = other.filter(F.col("n") < LONG).groupBy(*scope).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.sum("n").alias("n"))
    parts = alone.unionByName(pool.withColumn("part", F.lit("pool")).select(*scope, "part", "text", "n"))
    decided = parts.select(*scope, "text", "n", scorer(model)(F.col("text")).alias("c")).select(*scope, "text", "n", "c.lang", "c.confidence")
    latin = decided.groupBy(*scope, F.col("lang").alias("language")).agg(
        F.sum("n").alias("characters"), F.sum(F.size(words(F.col("text")))).cast("bigint").alias("words"),
        F.round(F.least(F.lit(1.0), F.sum(F.col("confidence") * F.col("n")) / F.sum("n")), 4).alias("confidence"),
    )
    return zh.unionByName(latin)


def dominant_script(text: Column) -> Column:
    """zh, latin or null: Han counts three times against the letters that are not Han."""
    h, rest = F.length(han(text)), F.length(letters(not_han(text)))
    return F.when(rest == 0, F.when(h > 0, "zh")).when(h * 3 > rest, "zh").otherwise("latin")


def with_language(segments: DataFrame, model: DataFrame) -> DataFrame:
    """Segments with `language`, the one they are mostly written in: zh where Han, counted three times, outweighs the other
    letters or is alone; else the classifier's, null where it is not sure; null without letters."""
    text = F.coalesce("text", F.lit(""))
    counted = segments.withColumns({"_han": F.length(han(text)), "_rest": F.length(letters(not_han(text)))})
    zh = (F.col("_han") * 3 > F.col("_rest")) & (F.col("_han") > 0)
    latin = F.when(~zh & (F.col("_rest") > 0), not_han(F.col("text")))
    named = counted.withColumn("_c", scorer(model)(latin))
    return named.withColumn("language", F.when(zh, F.lit("zh")).otherwise(F.col("_c.lang"))).drop("_han", "_rest", "_c")


def language_of(segments: DataFrame) -> Column:
    """The language column of segments that have one, else their script."""
    return F.col("language") if "language" in segments.columns else dominant_script(F.col("text"))


def script_split(segments: DataFrame) -> DataFrame:
    """doc_id, han_characters, other_letters, rejected: characters by script, and segments whose Han is not Chinese."""
    t = F.coalesce("text", F.lit(""))
    # segments delivered twice count once: told from numbers, so no text is shuffled
    rows = segments.select("doc_id", "seg_id", F.length(han(t)).alias("h"), F.length(letters(not_han(t))).alias("l"), is_cjk_other(t).alias("o")).distinct()
    return rows.groupBy("doc_id").agg(F.sum("h").alias("han_characters"), F.sum("l").alias("other_letters"), F.count_if("o").alias("rejected"))
