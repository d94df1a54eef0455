"""The corpus pipeline: quality, near duplicates, repeated strings, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, exact_dup, near_dup, packing, quality
from orrery.llm.common import Scratch, load
from orrery.llm.pieces import tokenizer_path

QUALITY_THRESHOLD = 0.3
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Bytes of a repeated string: passages of fifty words and more are longer.
REPEAT_BYTES = 200
SEQUENCE_TOKENS = 2048

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored QUALITY_THRESHOLD or more stay; the model learns from all labels of the table.

    Null, empty and wordless texts get the score of a text without lines, like every other text by the model alone;
    repeated rows get equal scores and stay or go together; null ids have no label; other columns are passed on as
    they are, whatever their names; an empty table stays empty.
    """
    model = quality.fit_quality(docs, load(spark, sf_dir, "labels"))
    return docs.where(quality.quality_column(model, F.col("text")) >= QUALITY_THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id.

    Null, empty and wordless texts are in no class and all stay; repeated rows are one class, of which one row stays;
    null ids are kept only where their class has no other id; other columns are passed on; an empty table stays empty.
    """
    return near_dup.keep_one_of_each(docs, near_dup.near_duplicates(docs, NEAR_WIDTH, NEAR_PERCENT))


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of REPEAT_BYTES bytes that occurs at two places is taken out of the texts, characters kept whole.

    All rows stay, with what is left of their texts; n_chars follows the text where the table has it. Null texts stay
    null, shorter texts as they are; repeated rows of that length lose all; null ids do no harm; other columns are
    passed on, whatever their names; an empty table stays empty.
    """
    names = docs.columns
    places = {c: f"c{k}" for k, c in enumerate(names)}
    whole = F.struct(*[(F.col("text").isNull() if c == "text" else F.col(c)).alias(places[c]) for c in names])
    cut = exact_dup.remove_repeats(docs.select("doc_id", "text", whole.alias("_rest")), REPEAT_BYTES, keep=["_rest"], as_text=True)
    values = {c: F.col("_rest")[places[c]] for c in names}
    values["text"] = F.when(~values["text"], F.col("kept_text"))
    if "n_chars" in names:
        values["n_chars"] = F.when(F.col("n_removed") == 0, values["n_chars"]).otherwise(F.length(values["text"])).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[values[c].alias(c) for c in names])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within its edit budget, go.

    Null and empty texts hold nothing and stay; repeated rows go or stay together; items without text match nothing;
    other columns are passed on; without items all documents stay.
    """
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces, packed into sequences.

    Null and empty texts are one piece, their end alone; repeated rows are packed each; null ids are kept; other columns
    are left behind; an empty table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path(packing.DEFAULT_TOKENIZER), SEQUENCE_TOKENS)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_array_dedup", repeated_string_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express none of the stages in full: tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
