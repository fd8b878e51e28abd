"""From raw documents to packed training sequences: five stages on Spark.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is
written as Parquet before the next one starts. The result of a stage names the intermediate tables that it
reads in its schema, and so does the copy that is written of it: a stage that is given such a copy removes the tables that the copy
has replaced, and no others. So stages share no state, and a result holds until its own copy is worked on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclespark.llm import line_dedup, near, packing, pii, quality
from cyclespark.llm.common import cut, may_hold, naming, noting, release, remove, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(stage: Stage) -> Stage:
    """``stage``, which first removes the tables that its written input has replaced, and names its own in its result."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        still = release(docs)
        with noting() as tables:
            out = stage(spark, docs, sf_dir)
        return naming(out, [*still, *tables])

    return run_stage


@tidy
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


@tidy
def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document that loses all its text goes with them."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))  # user columns may be named like those of the operator
    kept = line_dedup.dedup_lines(whole, min_lines=3, min_words=50)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    return kept.where(~emptied).select(*[F.col("text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest doc_id.

    Rows that share a doc_id are one group: the one of smallest text stays. Rows without a doc_id all stay.
    """
    judged = cut(near.near_duplicates(docs, width=5, percent=80), "near-verdicts")
    verdict = unused("_verdict", docs.columns)
    named = judged.where("doc_id is not null").groupBy("doc_id").agg(F.struct(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n")).alias(verdict))
    named = cut(named.where((F.col(verdict)["n"] > 1) | ~F.col(verdict)["kept"]), "near-named")
    # texts that stay as they are aren't shuffled, but for those that share their bit with one that doesn't
    hit = may_hold(named, "doc_id")(F.col("doc_id").cast("long"))
    some = docs.where(hit).join(named, "doc_id", "left")
    one = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), "text")).alias("_doc")
    repeated = some.where(F.col(verdict)["kept"]).groupBy("doc_id").agg(one).select("_doc.*")
    return docs.where(~hit).union(some.where(F.col(verdict).isNull()).select(*docs.columns)).union(repeated.select(*docs.columns))


@tidy
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", filter_quality),
    ("line dedup", remove_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read again from Parquet; what the last one reads stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with noting() as written:
            docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove(spark, before)  # the stage's input, which its written result has replaced
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising can't be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None
