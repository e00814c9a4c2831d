"""From raw documents to packed training sequences, as a chain of stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, language, neardup, packing, ragged, secrets
from tickloom.llm.samples import fold
from tickloom.sources.scratch import Scratch

#: Least confidence in a language with which a document stays.
LEAST_SCORE = 0.3


def _filtered(docs: DataFrame, scan: Callable[[DataFrame], DataFrame], keep: Column, made: tuple[str, ...]) -> DataFrame:
    """The rows of docs for which keep holds on what scan adds (the columns made); own columns of such names stay."""
    hidden = {c: f"_own_{c}" for c in docs.columns if c.lower() in made}
    shown = {v: k for k, v in hidden.items()}
    found = scan(docs.withColumnsRenamed(hidden)).where(keep).drop(*made)
    return found.withColumnsRenamed(shown).select(*docs.columns)


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ragged.small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or a clear language go, as do null and empty texts.

    Learned from rows with a lang, outside fold 1 of 3 of doc_id (rows without a doc_id are in no
    fold and teach nothing). Repeated rows share their verdict; own columns keep their names.
    """
    model = language.fit(docs.where(fold("doc_id", 3) != 1))
    clear = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return _filtered(docs, lambda d: language.predict(d, model), clear, ("lang_pred", "score"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on shingles of 5 words with 80 percent: the smallest doc_id.

    Rows that repeat that doc_id stay together; rows without a doc_id go. A null or empty text is
    a group of its own and stays.
    """
    return neardup.distinct(docs)


@_stage
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. A null or empty text has none and stays; repeated rows share their verdict."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _filtered(docs, lambda d: decontaminate.find(d, benchmark), F.size("hits") == 0, ("n_words", "hits", "items"))


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark, and n_chars, where docs has it, as the new text has it.

    A null text stays null, with a null n_chars; an empty one stays empty; repeated rows are redacted alike.
    """
    clean = _filtered(docs, lambda d: secrets.find(d, secrets.default_ranks(), redact=True), F.lit(True), ("secrets",))
    lengths = {f.name: F.length("text").cast(f.dataType) for f in docs.schema.fields if f.name.lower() == "n_chars"}
    return clean.withColumns(lengths) if lengths else clean


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of at most 4096 tokens.

    A null or empty text has the end id alone; repeated rows are packed as often as they come.
    """
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language model nor the signatures nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents one after another, each result written to the shared folder."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
