"""The corpus pipeline: quality, near duplicates, benchmark passages, source weights, token shards.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each stage's rows as Parquet in the shared
checkpoint folder and reads them as the next stage's docs. All but the last give the columns of documents.

Defined results: texts without a word (null, empty, blank) go with the quality stage, texts of any length are used whole;
rows with a null id or source stay as their texts deserve, only near copies need an id to be told; of rows with equal id
and text one stays; ties are settled as each stage's module says; an empty table gives no shards; columns besides those of
documents are kept up to the last stage, whatever their names.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from hgspark.llm import decontamination, mixing, near_duplicates, quality, token_output
from hgspark.tables import checkpoint_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, added=False)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_shards(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("token_output", tokenize)]

#: The classifier and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one's is written; the last one's input stays, as
    the result reads it."""
    folder, before = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
