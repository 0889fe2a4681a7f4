"""A corpus pipeline of five llm operators: from ``documents`` to packed training sequences.

Each stage works on all that the one before it kept and returns the columns of ``documents``; the last returns the pieces
of packed sequences. Stages raise what their operators raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_duplicates, packing, quality, substrings
from tessera.llm.frames import cut, quoted
from tessera.llm.queries import table, tokenizer_path

#: Documents that score less are rejected.
QUALITY = 0.3
#: The columns that the stages read or change; all others pass through, whatever their names.
ID, TEXT, LENGTH, REST = "doc_id", "text", "n_chars", "__rest"


def narrow(docs: DataFrame) -> DataFrame:
    """``docs`` with all that no stage reads in one column, so that no name clashes with an operator's columns."""
    rest = [quoted(c) for c in docs.columns if c not in (ID, TEXT, LENGTH)]
    return docs.select(ID, TEXT, LENGTH, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias(REST))


def widen(found: DataFrame, docs: DataFrame, text: Column | None = None, changed: Column | None = None) -> DataFrame:
    """The columns of ``docs``, with another text, and its length, where ``changed``."""
    if changed is not None:
        text = F.when(changed, text).otherwise(F.col(TEXT))
        length = F.when(changed, F.length(text).cast("long")).otherwise(F.col(LENGTH)).cast(docs.schema[LENGTH].dataType)
    own = {ID: F.col(ID), TEXT: F.col(TEXT) if text is None else text, LENGTH: F.col(LENGTH) if text is None else length}
    return found.select(*[own[c].alias(c) if c in own else F.col(f"{REST}.`{c.replace('`', '``')}`").alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, null and blank texts too. It learns from all labels, of any fold."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="quality")
    return widen(quality.score(narrow(docs), model, keep=True).where(F.col("score") >= QUALITY), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; all rows of that id stay, as they are one document."""
    gone = near_duplicates.groups(docs).where(~F.col("kept")).select(F.col(ID).alias("__gone")).distinct()
    return docs.join(gone, docs[ID].eqNullSafe(gone["__gone"]), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that an earlier document has; documents of which nothing is left go, untouched ones stay as they are."""
    found = substrings.deduplicate(narrow(docs))
    changed = F.col("dedup.n_removed") > 0
    return widen(found.where(~changed | (F.col("dedup.n_removed") < F.col("dedup.n_words"))), docs, F.col("dedup.kept"), changed)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; where those have a few benchmark words, these go."""
    blocks = decontamination.phrase_blocks(table(spark, sf_dir, "benchmark"))
    found = decontamination.judged(decontamination.scan(narrow(docs), blocks, keep=True)).where(~F.col("contaminated"))
    return widen(found, docs, F.col("kept"), F.col("n_hit") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of up to 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_one_of_each_group),
    ("substring dedup", cut_repeats),
    ("decontamination", keep_uncontaminated),
    ("packing", pack),
]
#: A classifier, approximate candidates and a tokenizer are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
