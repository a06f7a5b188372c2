"""The corpus pipeline: five stages, each writing what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, packing, quality, simhash, substrings
from corpusloom.llm.queries import tokenizer_path
from corpusloom.plans.runtime import materialize, read, ship, spread


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; what stays is as it was.

    Every row is judged by its own whole text, so repeated rows and equal texts share a fate and null ids are judged
    like others. Null and empty texts have all-zero statistics; a score on the threshold stays. Without labels every row
    stays; an empty table stays empty. Columns of any name pass through.
    """
    ship(spark)
    return quality.filter_quality(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id: five-word shingles, similarity 0.8 or more, links chain.

    SimHash fingerprints within four bits meet by Golay-code fuzzy hashing and are verified; prefix filtering adds the similar pairs beyond four bits.
    Null and empty texts are one group; texts under five words are one shingle; texts of any length are whole. Different
    texts of one doc_id are different documents; rows of one id in one group are one. A row with null doc_id stays, once, only where its group has
    no other row. An empty table stays empty. Columns of any name pass through.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has go from the text; n_chars follows the text.

    Kept words are joined by one blank. Null text becomes the empty text; texts under 50 words lose nothing; texts of any length are whole.
    Rows that repeat a doc_id are judged each, against smaller ids only; rows with null doc_id lose nothing and
    cover nothing. No row goes; an empty table stays empty. Columns of any name pass through.
    """
    ship(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = substrings.remove_repeats(docs.select("doc_id", "text", F.struct(F.lit(1), *rest).alias("rest")))
    out = kept.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "n_chars", "rest.*")
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target weights: documents are left out, kept or repeated, never changed.

    Null is a source, the last one; null text has size 0; a null doc_id hashes like any value. Rows equal in doc_id,
    source and text are interchangeable. An empty table stays empty. Columns of any name pass through.
    """
    ship(spark)
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; one row for each piece of a document.

    Null and empty texts are their end token alone; only longer documents are cut. Rows with null or repeated doc_id
    have their own pieces; pieces of equal length take their places by id. An empty table gives an empty result. Extra columns are ignored.
    """
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicate removal", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: Learned scores, shingle similarities and hash thresholds have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spread(read(spark, sf_dir, "documents"))
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{number}")
    return docs
