"""The corpus pipeline: what is toxic goes, one document of each near-duplicate group stays, personal
data is masked, sources are mixed to their weights, and the mix is packed into sequences.

Each stage is judged on its own input, so its statistics, classes and budgets are those of what its
predecessor kept. All stages but the last return the columns of ``documents``.

Defined results: a null text counts as empty, is clean, alike to nothing, taken 0 words by the mix and so not
packed; a null id is kept by the first three stages; repeated rows of one id are judged alike and, where they
differ in text, by one text of the id in the second stage, and each is a document of its own in the mix;
ties go as the operators' docstrings say; very long texts are worked on whole; an empty table gives an empty
result; further columns pass through all stages but the last, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm import common, mixing, near_dedup, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier predicts to be toxic. It learns from the labels of
    those documents of the input whose labels may be learnt from. A null id stays with its text's verdict.
    Written here, as the size of batches holds where a job is run."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    return common.stage_in_small_batches(toxicity.keep_clean(docs, model))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id. Rows with a null id stay."""
    classes = near_dedup.near_duplicates(docs)
    gone = classes.filter("class_id <> doc_id").select("doc_id")
    return near_dedup.without(docs, gone)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in square brackets; n_chars follows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = pii.detect(docs.select("doc_id", "text", row))
    masked = found.select("row", pii.redacted(found).alias("masked"))
    made = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return masked.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs, mixing.mix(docs.select("doc_id", "text", "source")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences. A document that the mix repeats is packed each time."""
    return packing.pack(common.stage_in_small_batches(packing.pieces(docs, packing.tokenizer_path())))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, signatures and tokenizer can't be expressed in SQL; the tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir))
    return docs
