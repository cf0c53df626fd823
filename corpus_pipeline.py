"""Corpus pipeline: language, quality, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``docs``.  `run` writes every stage to the shared folder and reads it
again as the next one's input, so a lost executor costs no earlier stage.

Defined results, for every stage: an empty table gives an empty result; columns of any
name are kept, also those that a stage uses inside; texts are read whole.  Documents
without a letter (or text) leave at the first stage, wordless ones score the labelled
share at the second.  At the third, the smallest id of a group stays (ties: see
`jaccard.one_of_each`), rows of one id with different texts are different documents and
null ids come last.  The mixture may leave a document out or repeat it, as its rate
says; repeated rows get the same number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.llm import bpe, common, jaccard, langid, mixing, quality

#: A document whose best language has a smaller posterior is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: A document with a smaller vote for label 1 is rejected.
LEAST_QUALITY = 0.3
#: Near copies: this similarity (percent) or more on word n-grams of this length; op8_jaccard keeps its own contract.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of `LEAST_LANGUAGE_SCORE` or more; ties between languages go to the first by name."""
    langs, prob, pieces = langid.fitted(docs)
    lang, score = common.free_name(docs, "__lang"), common.free_name(docs, "__lang_score")
    done = langid.predict(docs, langs, prob, pieces, lang_out=lang, score_out=score)
    return done.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose vote for label 1 is `LEAST_QUALITY` or more; a tie of neighbours goes to the smaller labelled id."""
    score = common.free_name(docs, "__quality")
    done = quality.score(docs, quality.fitted(spark, sf_dir, docs), score_col=score)
    return done.where(F.col(score) >= LEAST_QUALITY).drop(score)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that domains meet their target shares of tokens."""
    tokens, membership, rate, copy = (common.free_name(docs, f"__{x}") for x in ("tokens", "membership", "rate", "copy"))
    rated = mixing.mix(docs, mixing.labelled_documents(spark, sf_dir, docs), mixing.TARGETS, new=(tokens, membership, rate))
    copies = mixing.copies(F.col(rate), F.col("doc_id"))
    return rated.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*[common.col(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text and the digests of ids and decoded text; repeated documents are encoded one by one."""
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), bpe.default_tokenizer())
    return done.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("language", language), ("quality", good), ("unique", unique), ("mixture", mixture), ("token_ids", token_ids)]

#: The stages learn models; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
