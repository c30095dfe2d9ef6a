"""Documents to packed training sequences: quality rules, one document of each near-duplicate group, repeated
passages cut, personal data masked, and the rest packed.

A stage takes the session, the documents that its predecessor kept, and the folder of the tables; it returns
the documents that it keeps, changed or not. The last stage returns the packed pieces.

Cases, the same for every stage: no rows in, none out; columns beyond those of documents ride along whatever their names, up to the
packing; rows that repeat are judged each, but the near-duplicate stage keeps one of them. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import jaccard, packing, pii, quality, suffixes
from postlens.llm.common import documents, stage_table


#: Passages of this many bytes that stand anywhere else are cut: some 40 words, so one of over 50 words holds one even if they are short.
PASSAGE_BYTES = 200


def _carried(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row in one column, so no name of a document's column meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))


def _with_text(found: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The carried rows with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the learned rules reject. A null or empty text, and one long word, have too few words and
    go; a null id has no label and is judged like any other row; without labels only the base rule rejects."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rules = quality.learn(docs, labels)
    return quality.judge(_carried(docs), rules, keep=("row",)).where("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of the Jaccard join, and one row of those that repeat with their id. A
    text without words links with nothing and stays; a null id stays by itself."""
    return jaccard.distinct_documents(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; a text may end up empty, and what a cut leaves of a character goes with it. A text may repeat itself; of
    repeated rows each loses what the others hold too. Null and empty texts come out empty."""
    cut = suffixes.remove_repeats(_carried(docs), keep=("row",), form="text", window=PASSAGE_BYTES)
    return _with_text(cut, F.col("kept_text"), docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind; of spans that overlap nothing stays. Null and empty texts have none."""
    found = pii.find_spans(_carried(docs), pii.train(spark), keep=("row",))
    return _with_text(found, pii.redacted(F.col("text"), F.col("spans")), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; an empty text is the end id alone, and rows that repeat or have no id are packed each."""
    import public_tokenizers as tokenizers

    return packing.pack_documents(docs, tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("suffix_dedup", repeated_passage_stage),
    ("pii", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: The learned stages cannot be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
