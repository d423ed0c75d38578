"""From raw documents to a sharded training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``: a lost executor costs one stage at most. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, langid, mixing, sharding, simhash
from millrace.llm.common import release, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the labelled documents teach, go.

    Null and empty texts have no letter; a null ``lang`` teaches nothing and its document is judged like any other.
    Repeated rows share their fate; an empty table, or one without labels, gives none.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity of 0.8 or more), the document with the smallest id stays.

    Null, empty and wordless texts are copies of each other; of equal ids the smaller text key counts, null ids come
    last, and of repeated rows one stays.
    """
    return simhash.keep_one_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage within the allowed edits of a benchmark item go.

    Null and empty texts hold nothing and stay, repeated rows share their fate, an empty benchmark takes nothing away.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is cut or repeated to its target; a document comes as often as the mix takes it.

    Null sources are one source; null, empty and wordless texts have size zero and come with the epochs of their source. Ties in
    the keys are broken by the text, and repeated rows come as often as each of them is taken.
    """
    return mixing.repeat(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus in shards of the target size; one row per stored document with its shard.

    Every row, repeated ones and those with nulls too, lies in one shard; an empty corpus has none.
    """
    return sharding.shard(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
    ("shards", shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Other columns of ``documents`` pass through the
    stages, whatever their names. The Parquet files between stages go once the last one has stored its shards."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        release(spark)
    out = STAGES[-1][1](spark, docs, sf_dir)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
