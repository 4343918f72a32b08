"""A training corpus from documents: five stages, each by one operator of graphloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as Parquet in
the shared folder and reads it again for the next. A stage begins by freeing what the
one before left in the executors' memory, whose frame is only computed after it returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard_join, packing, pii, quality
from graphloom.llm.common import Scratch, free_executors, small, table


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the rows do not have."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a key of id and text, so that rows with one id and different texts are judged on their own; and its name.

    A null id or text has a key as well; only rows equal in both share one.
    """
    name = _fresh(docs, "_key")
    key = F.concat(F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("")), F.lit(":"), F.hex(F.xxhash64("text")))
    return docs.withColumn(name, key), name


def _without(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """Keyed docs but those of the rejected keys (column k): by broadcast while they are few, else by a shuffled join."""
    return docs.join(small(rejected.select(F.col("k").alias(key)).distinct()), key, "left_anti").select(*[c for c in docs.columns if c != key])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go.

    Null and empty texts are scored like others; repeated rows and ties have one
    score and stay or go together; without labels of both classes the model's
    constant score decides. Further columns, whatever their names, stay.
    """
    free_executors(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    docs, key = _keyed(docs)
    scored = quality.score_documents(docs.select(F.col(key).alias("k"), "text"), model, "k").filter("predicted = 0").select("k")
    return _without(docs, key, Scratch(spark, "quality-stage").save(scored, "rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: that of the smallest key.

    Texts without words (null, empty, white space) are in no group and all stay; of
    rows that repeat with id and text one stays.
    """
    free_executors(spark)
    docs, key = _keyed(docs)
    linked = jaccard_join.jaccard_components(docs.select(F.col(key).alias("k"), "text"), "k", n=5, percent=80)
    linked = Scratch(spark, "near-stage").save(linked, "linked")
    kept = _without(docs, key, linked.filter(F.col("k") != F.col("component_id")))
    again = linked.filter((F.col("k") == F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy("k").count().filter("count > 1").select("k")
    if again.isEmpty():
        return kept
    kept, key = _keyed(kept)  # rows that repeat with id and text: one of each stays
    again = again.withColumnRenamed("k", key)
    once = kept.join(again, key, "left_semi").dropDuplicates([key])
    return kept.join(again, key, "left_anti").unionByName(once).select(*[c for c in kept.columns if c != key])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; an empty benchmark lets all stay;
    repeated rows stay or go together.
    """
    free_executors(spark)
    docs, key = _keyed(docs)
    found = decontaminate.find_contamination(docs.select(F.col(key).alias("k"), "text"), table(spark, sf_dir, "benchmark"), "k")
    return _without(docs, key, Scratch(spark, "leak-stage").save(found.filter("contaminated").select("k"), "rejected"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows where a text changed.

    Null and empty texts stay as they are, and no row goes.
    """
    free_executors(spark)
    made = _fresh(docs, "_redacted")
    changed = pii.redact(docs, pii.train(*pii.labelled_windows(docs)), out_col=made)
    new = F.col(f"{made}.text")
    length = F.when(F.col(f"{made}.changed"), F.length(new).cast("long")).otherwise(F.col("n_chars"))
    # written here, in small Arrow batches: an executor's buffers grow with what a batch holds
    return Scratch(spark, "private-stage").save(changed.withColumns({"text": new, "n_chars": length}).drop(made), "redacted")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences; a null or empty text is its end token."""
    free_executors(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("best-fit packing", packing_stage),
]

#: Training a classifier and a tagger is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
