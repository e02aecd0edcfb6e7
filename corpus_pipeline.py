"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage's result to the shared folder
and reads it back, so a lost executor costs the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.staging import staged
from caseloom.llm import language, near, packing, substrings, toxicity

#: A language is believed from this posterior on.
SURE = 0.4
#: A text whose likelihood in its best language is below this, in nats a letter, is in none
#: that was learned: even letters dealt by chance from an alphabet of 90 would explain it better.
STRANGE = -4.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, tuple, str]:
    """``docs`` under names that no stage uses, those names, and that of the text."""
    names = tuple(f"column{i}" for i in range(len(docs.columns)))
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the lexicon is learned from the labels.

    Columns of any name stay as they are.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, names, text = _numbered(docs)
    scored = toxicity.score(rows, model, text=text, keep=names)
    return scored.filter("predicted = 0").select(*names).toDF(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter and are told to be in one learned language.

    The score is the posterior among the learned languages; the likelihood a letter tells
    random letters and other languages apart. Columns of any name stay.
    """
    model = language.fit(docs, public_tokenizers.path(language.VOCABULARY))
    rows, names, text = _numbered(docs)
    told = language.predict(rows, model, text=text, keep=names)
    return told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)
                       & (F.col("per_letter") >= STRANGE)) \
        .select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.one_of_each(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; lengths follow.

    Other columns of any name stay as they are.
    """
    rows, names, text = _numbered(docs)
    at = dict(zip(docs.columns, names))
    cut = substrings.remove_repeats(rows, text, at["doc_id"])
    length = F.when(F.col("n_removed") == 0, F.col(at["n_chars"])).otherwise(
        F.length("kept")).cast(docs.schema["n_chars"].dataType)
    now = {"text": F.col("kept"), "n_chars": length}
    return cut.select(*[now.get(c, F.col(n)).alias(c) for c, n in at.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unknown_language),
          ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", cut_repeats),
          ("packing", pack)]

#: The classifiers and the tokenizer have no SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
