"""A training-data pipeline over documents: five stages of the operators in fathomline.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next stage's docs. A stage sees what its predecessor
kept, and all but the last return the columns of documents. Documents may have further columns, of any names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import decontaminate, exact_dup, language, near_dup, packing
from fathomline.llm.queries import remainder, tokenizer_file
from fathomline.llm.shared import read_table, written

#: Models and a tokenizer take part, so SQL can't express the result.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: those that are null or have no letter. A known one stays, however short or mixed it is. Rows are judged one by one, so null or repeated ids and repeated rows change nothing."""
    return language.known_languages(docs, docs.where(remainder(3) != 1))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays; null ids come after all others, and of rows with the same smallest id one stays. A null text equals an empty one."""
    return exact_dup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity .8), the row with the smallest doc_id stays; null ids come after all others. Rows are told apart even where they share an id; texts without words all stay."""
    return near_dup.drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go, whatever their ids; those without words stay."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Null texts are their end token alone; rows that share an id are documents of their own."""
    return packing.pack(docs, tokenizer_file(), end=1)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
