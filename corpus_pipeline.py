"""A pipeline over `documents`: toxicity, language, line dedup, near-dedup, packing.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that its predecessor kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import language, line_dedup, near_copies, packing, toxicity
from gridspark.llm.common import free, stashes, table

#: A text is toxic from this probability on.
TOXIC_FROM = 0.7
#: Texts whose best cosine is under this are in no known language. Of texts in scripts that no language of the corpus
#: has, 0.064 is the upper tenth (320 invented texts); of 4,000 training texts of sf0.1, all but two (0.030 and 0.038)
#: have 0.100 or more.
LANGUAGE_FROM = 0.08
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, as they are."""
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, keep=COLUMNS)
    return scored.where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus, as they are; texts without letters and of no known language go."""
    names, prototypes = language.fit(docs, ~language.held_out())
    found = language.identify(docs, names, prototypes, keep=COLUMNS)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_FROM)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the text that is left, and its n_chars; those of which nothing is left go."""
    left = line_dedup.line_dedup(docs.select(*COLUMNS))
    rest = left.where((F.col("n_deleted") == 0) | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    size = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.withColumn("n_chars", size).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest doc_id, null last, then of the smallest hash of its text,
    then of the smallest lang, source and n_chars."""
    with stashes(spark) as keep:
        groups = near_copies.near_copies(docs.select(*COLUMNS))
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
        first = groups.groupBy("component", order.alias("row")).agg(F.count("*").alias("n")).groupBy("component").agg(F.min_by("n", "row").alias("n"), F.min("row").alias("row"))
        kept = keep(first.select(F.col("row.doc_id").alias("__id"), F.col("row.text_key").alias("__key"), "n"), "kept")
    rows = docs.select(*COLUMNS, near_copies.text_key("text").alias("__text"))
    rest = rows.join(kept.select("__id", "__key").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_semi")
    if not kept.where("n > 1").isEmpty():
        least = F.min(F.struct("lang", "source", "n_chars", "text")).alias("row")  # texts of one hash are one text
        rest = rest.groupBy("doc_id", "__text").agg(least).select("doc_id", "row.*")
    return rest.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The stages cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has stored for itself, and its input, go once its output is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with stashes(spark) as keep:
            left = keep(stage(spark, docs, sf_dir), name)
        free(docs)
        docs = left
    return STAGES[-1][1](spark, docs, sf_dir)
