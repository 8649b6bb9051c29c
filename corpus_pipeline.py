"""A corpus pipeline of five stages, each one of the operators in tilewright.llm.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of docs, whatever they are.
Decisions on single texts (toxicity, language) filter where the texts are read; decisions that
compare texts come back as the rows that go, named by id and text digest, which are few and, while
counted to be few, broadcast: rows of one id (or of none) with other texts are not touched.

Defined results: a null text is not toxic, in no language (it goes there), and a copy of an empty one;
null ids come last where the largest or smallest stays; rows equal in id and text are copies; of
near copies the first of each connected group stays, so a row may go that is like another which goes, and
not like the one that stays; in an empty table nothing is learned and nothing goes; further columns,
whatever their names, are kept as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm import exact_dedup, langid, ngram_join, packing, toxicity
from tilewright.llm.common import bucket_of, documents, labels, release, small_or_shuffled, tables, written

#: Of the texts held out from learning, the share that may be less like their language than a text that stays.
RARE = 0.001
STEPS = 10_000
FOLDS, FOLD = 4, 2


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _stay(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that found (doc_id, digest, kept) doesn't drop; of rows equal in id and text one stays."""
    found = written(found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"), "kept"), "found")
    gone = small_or_shuffled(written(found.where("not kept").select("__id", "__of").distinct(), "gone"))
    again = written(found.where("kept").groupBy("__id", "__of").count().where("count > 1").select("__id", "__of"), "again")
    named = docs.withColumn("__digest", _digest(docs["text"]))
    kept = named.join(gone, _same(named, gone), "left_anti")
    if not again.isEmpty():
        again = small_or_shuffled(again)
        twins = named.join(again, _same(named, again), "left_semi").dropDuplicates(["doc_id", "__digest"])
        kept = kept.join(again, _same(kept, again), "left_anti").unionByName(twins)
    return kept.drop("__digest")


def _same(named: DataFrame, ids: DataFrame) -> Column:
    return named["doc_id"].eqNullSafe(ids["__id"]) & (named["__digest"] == ids["__of"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, labels(spark, sf_dir), folds=5, fold=0)
    return docs.where(toxicity.score_column(model, docs["text"]) < 0.5)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in one of the languages learned.

    Rejected are texts without a letter, and those less like the language they are nearest to than all but
    RARE of that language's texts that were held out from learning: mixtures of languages, and noise.
    """
    held_out = bucket_of(docs["doc_id"], FOLDS) == FOLD
    profiles = langid.learn(docs.where(~held_out))
    told = docs.where(held_out & F.col("lang").isNotNull()).select(F.col("lang").alias("__lang"), langid.language_column(profiles, docs["text"]).alias("__found"))
    # Counted by steps of a ten-thousandth, which gives the same limit whatever the partitions.
    steps = told.where(F.col("__found.lang_pred") == F.col("__lang")).groupBy("__lang", F.floor(F.col("__found.score") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__lang").orderBy("step")
    share = F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("__lang"))
    least = steps.withColumn("share", share).where(F.col("share") > RARE).groupBy("__lang").agg((F.min("step") / STEPS).alias("least")).collect()
    found = langid.language_column(profiles, docs["text"])
    # One number for each language learned, of which learn() bounds the number.
    floor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in least for x in (r["__lang"], r["least"])]), found["lang_pred"]), F.lit(0.0)) if least else F.lit(0.0)
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= floor))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(docs)
    return _stay(docs, found.select("doc_id", F.unhex("text_sha256").alias("digest"), "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _stay(docs, ngram_join.decide_copies(docs.withColumn("__digest", _digest(docs["text"])), "__digest", threshold=0.8, words=5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: No SQL says what the learned stages keep; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = documents(spark, sf_dir), tables()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, docs, since=mark)
    return STAGES[-1][1](spark, docs, sf_dir)
