"""Training-data pipeline: documents in, a mixed corpus out.

Each stage is a (name, function) pair; a function takes (spark, docs, sf_dir)
and returns a DataFrame. ``run`` writes every stage's result as Parquet under
the shared checkpoint folder and rereads it as the next one's docs, so a lost
executor repeats one stage at most.

* toxicity: documents with a score of 0.3 or more go (model fitted on the
  labelled documents of the table).
* near duplicates: of each component at five-word shingles and similarity
  0.8 the document with the least doc_id stays.
* decontamination: documents that contain a benchmark window of ten words go.
* mixing: copies of what is left, source by source, toward 5, 2, 1 in turn;
  returns doc_id, size, source_size, target and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerlake.llm import decontam, minhash_dedup, mixing, queries, toxicity
from tickerlake.llm.tables import stored, table

# A trained model and iterated joins have no SQL form; tests compare the
# stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, queries.toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs, minhash_dedup.Options(shingle=5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
