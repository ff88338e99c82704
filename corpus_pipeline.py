"""From raw documents to token ids: language ID, line dedup, near duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and gives them, reread, to the next. All but the last return the columns of documents, with n_chars
brought up to date where the text changed. Part of the llm subpackage in all but its place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dup
from tidemark.llm.shared import importable, new_path, scratch


#: Pre-tokens that a worker remembers: fewer than for encoding alone, as workers go on holding them while other stages run.
MEMO = 500_000


def _apart(docs: DataFrame) -> DataFrame:
    """docs with a prefix before all names, so that no column can clash with those that operators add."""
    return docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns})


def _back(found: DataFrame, docs: DataFrame, text=None) -> DataFrame:
    """The columns of docs again, with a new text and its length if one is given."""
    new = {c: F.col(f"in_{c}") for c in docs.columns}
    if text is not None:
        new["text"] = text
        if "n_chars" in new:
            new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*(x.alias(c) for c, x in new.items()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-centroid model rejects go: no letter, or far from every language. The model learns
    from the documents that op1_language_id learns from."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(_apart(docs), model, text="in_text")
    return _back(found.where(~F.col("rejected")), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; documents stay, if need be with an empty text."""
    found = line_dedup.drop_frequent_lines(_apart(docs), text="in_text")
    return _back(found, docs, F.col("kept_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked by five-word shingles at 0.8 or more, the document of least id stays.
    Documents without words (null, empty) all stay; null ids come last; of rows equal in id and text one stays."""
    return near_dup.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of ten words or more of a benchmark item go; so do documents that consist of them for more than half.
    Null and empty texts stay as they are, rows are judged one by one, and without items nothing goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.clean(_apart(docs), items, text="in_text")
    return _back(found, docs, F.col("in_text"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and digests of the ids and of what they decode to. A null text is
    encoded as an empty one; each row gives one."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), path, public_tokenizers.PATTERN, memo=MEMO)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        "ids_le",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("byte_bpe", encode_tokens),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):  # what a stage stores on its way goes once its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
