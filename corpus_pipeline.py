"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and all but
the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet into the
shared folder and reads them as the next one's documents, so a stage that fails or loses
executors starts from its predecessor's table.

1. toxicity: documents that the classifier (fitted on the labels of ``labels``) scores 0.5 or more go;
2. n-gram Jaccard join: of each component of near copies (five words, similarity 0.8) the document with the
   smallest id stays;
3. suffix-array dedup: strings of 50 bytes that an earlier document has are cut out;
4. PII: validated numbers, dates, addresses and secrets become pseudonyms;
5. packing: token sequences of at most 2048 ids; one row per piece.

Rows without an id are kept by 2 (they link with nothing). A text that 3 cuts down to nothing stays as an empty
document. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import jaccard_join, packing, pii, suffix_dedup, toxicity
from panelcast.llm.common import saved, table
from panelcast.llm.queries import VOCABULARY
from panelcast.session import ensure_checkpoint_dir, ship_package


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs, model, score_col="__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    found = jaccard_join.join_components(docs, jaccard_join.Rule(n=5, percent=80))
    copies = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return _counted(suffix_dedup.deduplicated(docs, length=50))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.pseudonymise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: Trained scores, checksums of ids and keyed permutations aren't SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
