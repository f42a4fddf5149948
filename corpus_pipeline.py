"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the
columns of ``documents``, whatever else they are called, and each works on all
that the one before it kept.  An empty table gives no row at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, packing, quality, simhash, substring
from gleaner.llm.common import materialize, table
from gleaner.session import discard, ship


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the line model does not reject.

    Null and empty texts are scored as one empty line; a score of just 0.5 is
    kept; repeated rows stay or go together; long texts are read whole.
    """
    ship(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every class of near-duplicates.

    Null ids and texts without words always stay; all rows of one id stay or go
    together, so repeated rows of a kept id stay; a text of fewer than five
    words is one shingle; long texts are read whole.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words that stand in an earlier window of twenty; the other words keep their white space.

    Null, empty and short texts stay as they are; of equal passages the one of
    the least id stays, null ids coming last; an emptied document stays, empty.
    """
    ship(spark)
    new = [next(n for n in (base + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("words", "removed", "left")]
    out = substring.remove_repeats(docs, joined=False, columns=new)
    cut = F.col(new[1]) > 0
    text = F.when(cut, F.col(new[2])).otherwise(F.col("text"))
    size = F.when(cut, F.length(new[2]).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": size}).drop(*new)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that leak no benchmark item.

    Null and empty texts and null ids are clean unless their text leaks; an item
    of fewer than five words matches a text that is nothing else; repeated rows
    go together; long texts are read whole.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a packed sequence for every piece of every document.

    Null and empty texts are one piece of the end id; repeated rows and null
    ids are packed each; long texts are cut, nothing is lost.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]

#: SQL has neither the model nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written once, as a cluster would hand them on."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            discard(before)
    return docs
