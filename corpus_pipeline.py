"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes the documents that its predecessor kept, and all but the last return
documents with the same columns. Between stages the documents are a table in the shared
folder, so a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.llm.common import row_key, table, written
from floppyscope.llm.decontaminate import decontaminate as find_contaminated
from floppyscope.llm.decontaminate import small
from floppyscope.llm.linededup import dedup
from floppyscope.llm.packing import pack
from floppyscope.llm.quality import fit_on_labels, keep_good
from floppyscope.llm.simhash import near_duplicates

#: Words of a shingle in the near-dedup stage; its links share 0.8 of their shingles or more.
WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; a null text has no words and goes.
    The classifier learns from those of ``labels`` that are among the documents."""
    return keep_good(docs, fit_on_labels(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that equal or nearly equal an earlier one, and drops a document that loses
    every line by that. A document without lines stays as it is."""
    found = dedup(docs).where("n_removed = 0 OR n_removed < n_lines")
    out = found.select("document.*")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of near-duplicates the document with the least doc_id (null last,
    equal ids by a hash of the text), and of rows equal in id and text one."""
    rows = docs.select(F.struct("*").alias("document"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_key().alias("key")).alias("id"))
    found = near_duplicates(rows.select("id", "document.text"), words=WORDS)
    listed = written(found.groupBy("id").agg(F.count("*").alias("times"), F.bool_or(F.col("id") != F.col("component_id")).alias("later")).where("later OR times > 1"), "near-duplicates")
    kept = _without(rows, listed.where("later").select("id"))
    twins = listed.where("NOT later").select("id")
    if twins.isEmpty():
        return kept.select("document.*")
    other = small(twins).select(F.col("id").alias("other"))
    again = kept.join(other, kept["id"].eqNullSafe(other["other"]), "left_semi").dropDuplicates(["id"])
    return _without(kept, twins).unionByName(again).select("document.*")


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose id, all of its parts compared null-safely, isn't among ``ids``."""
    other = small(ids).select(F.col("id").alias("other"))
    return rows.join(other, rows["id"].eqNullSafe(other["other"]), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    found = find_contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = written(found.where("contaminated").select(F.struct("doc_id", "key").alias("id")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("document"), F.struct("doc_id", row_key().alias("key")).alias("id"))
    return _without(rows, hit).select("document.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of the documents into sequences; one row per piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier of the first stage can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None
