"""A corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage gets the table that the one before has written, and works on all its rows. All but the
last return the columns of ``documents``, whatever those are; other columns travel in one struct,
so that none can clash with a column of an operator.

Rows with a null doc_id pass the two duplicate stages unchanged. A document that loses all its
words in the fourth stage stays as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import count_min, line_crf, minhash, packing, toxicity
from evenkeel.llm.queries import WORD_LEVEL, table
from evenkeel.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No stage but the counting of the first can be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def _bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_none")).alias("_row"))


def _unbundled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`").alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are content by at least half of their words."""
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    judged = line_crf.judge(_bundled(docs), field, line_crf.SHARE, "text", "_row")
    return _unbundled(judged.where("kept"), docs.columns)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(_bundled(docs), model, "text", "_row")
    return _unbundled(scored.where("predicted = 0"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest id."""
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    found = minhash.near_duplicates(keyed, "_text_key", shingle=5, percent=80).where("kept")
    kept = found.select(F.col("doc_id").alias("_kept_id"), F.col("_text_key").alias("_kept_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_text_key") == F.col("_kept_key"))
    return keyed.join(kept, same, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; ``n_chars`` is counted anew."""
    left = count_min.remove_repeats(_bundled(docs), "_row", rejoin=False)
    out = _unbundled(left, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of what is left in a sequence of at most 2048 tokens."""
    return packing.pack_documents(docs, WORD_LEVEL, capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_texts),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
