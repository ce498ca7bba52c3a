"""documents -> packed training sequences: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes all rows its predecessor kept and returns documents' columns; the last returns the packed pieces.
All of them take null, empty and very long texts, null and repeated ids, repeated rows, further columns of any name
and empty tables; each says what these give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathlens.llm import best_fit, decontaminate, near_copies, pii, quality_gbdt, runtime
from pathlens.llm.queries import QUALITY_CUT
from pathlens.llm.simhash_vptree import free_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier does not reject.

    A row is judged by its text alone, null as empty, so repeated rows go or stay together. Ties at the cut stay. An
    empty table gives an empty one.
    """
    forest = quality_gbdt.train(docs, runtime.read_table(spark, sf_dir, "labels"))
    score = free_name(docs, "__quality")
    return quality_gbdt.score(docs, forest, out_col=score).filter(f"`{score}` >= {QUALITY_CUT}").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: Jaccard 0.8 or more over 5-word shingles.

    Null and empty texts are copies of each other. Of a group the row smallest by (id, words, text, whole row) stays,
    ids that are null last; a row goes for its own text only, so repeated ids with other texts stay. An empty table
    gives an empty one.
    """
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay. A row is judged by its text alone. An empty table, or benchmark, drops
    nothing.
    """
    return decontaminate.drop_contaminated(docs, runtime.read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms in texts, and sets n_chars anew.

    No row goes. Null and empty texts stay as they are; rows of the same text get the same new one. An empty table
    gives an empty one.
    """
    return pii.sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' token ids into sequences.

    Null and empty texts are the end id alone; longer ones than a sequence are cut; rows that repeat an id are packed
    each. An empty table gives no piece.
    """
    return best_fit.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
#: Fingerprints, trained models and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = runtime.stage(docs, f"pipeline-{name}")
    return docs
