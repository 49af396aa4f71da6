"""The corpus pipeline: five stages from documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All but the last keep
the columns of documents; each begins by giving back memory of the one before; repeated rows, nulls and empty tables pass through as
the stages' operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantmere.llm.common import give_back, shared_path, table
from quantmere.llm.decontamination import remove_contaminated
from quantmere.llm.mixing import mixed_documents
from quantmere.llm.near_dedup import keep_one
from quantmere.llm.queries import tokenizer_path
from quantmere.llm.token_store import token_table
from quantmere.llm.toxicity import remove_toxic

MIX_SEED = 17


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go."""
    give_back(spark)
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of the least id."""
    give_back(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    give_back(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them; documents without words, of which nothing can be taken, go."""
    give_back(spark)
    return mixed_documents(docs, seed=MIX_SEED)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; per document its place, length and checksum read back from them."""
    give_back(spark)
    return token_table(docs, tokenizer_path(), end_id=2, out_dir=shared_path(spark, "corpus-tokens")).select("doc_id", "start", "n_tokens", "ids_crc32", "path")


STAGES = [
    ("toxicity", toxicity),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token-ids", token_ids),
]

#: The classifier, the hashed sketches and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
