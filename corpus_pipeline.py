"""A corpus from raw documents: five stages, each applying one operator of ``loomstat.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import decontaminate, mixing, neardup, tokens, toxicity
from loomstat.llm.shared import free_names, stored, table
from loomstat.session import scratch_path

#: Share of all words that the mixture keeps.
SHARE = 0.8
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; learned from all labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, toxic = free_names(docs, "_score", "_toxic")
    scored = toxicity.score(docs, model, score_col=score, predicted_col=toxic)
    return scored.where(F.col(toxic) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document with the smallest id of every group, once if its row is repeated; rows with a null id or no words stay."""
    own_id, own_hash, keeps, rows = free_names(docs, "_id", "_hash", "_kept", "_rows")
    found = neardup.near_duplicates(docs, size=5, percent=80, hash_col=own_hash)
    texts = found.where("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias(own_id), own_hash)
    texts = texts.agg(F.min("kept").alias(keeps), F.count(F.lit(1)).alias(rows)).where(~F.col(keeps) | (F.col(rows) > 1))
    texts = stored(texts, "near-duplicates")
    same = [F.col("doc_id") == F.col(own_id), F.xxhash64(F.col("text").cast("string")) == F.col(own_hash)]
    again = texts.where(keeps)
    if again.isEmpty():
        return docs.join(texts, same, "left_anti")
    return docs.join(texts, same, "left_anti").union(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, edits of up to a fifth of its words allowed."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``SHARE`` of the words by target weights, each document at most once; a leaf's last one is cut to its first words."""
    domain, epoch, tokens_, taken = free_names(docs, "domain", "_epoch", "_tokens", "_taken")
    levels = [domain, *mixing.LEVELS[1:]]
    weights = mixing.weight_table(spark).withColumnRenamed(mixing.LEVELS[0], domain)
    chosen = mixing.mix(docs.withColumn(domain, mixing.domain()), levels, weights, share=SHARE, max_epochs=1, seed=mixing.SEED,
                        names=(epoch, tokens_, taken))
    cut = F.col(taken) < F.col(tokens_)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), F.lit(1), F.col(taken).cast("int")), " ")
    text = F.when(cut, first).otherwise(F.col("text"))
    size = F.when(cut, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return chosen.withColumn("n_chars", size).withColumn("text", text).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids below the shared folder, read back through their index."""
    folder = scratch_path(spark, "corpus")
    tokens.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return tokens.read_shards(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token-ids", token_ids),
]

#: No SQL: the first three stages learn, sketch and match with edits.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
