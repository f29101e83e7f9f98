"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, byte-level BPE, over the whole of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any further
names; but for the last, it returns the columns that it was given."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morpholake.llm import bpe, decontaminate, langid, secrets, simhash
from morpholake.llm.common import column, fold, free_name, new_path, table
from morpholake.llm.queries import BPE_FILE

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (und) or with a posterior under LEAST_SCORE; learns from three folds of four.

    Null texts and texts without a letter go.  A null lang teaches nothing but is judged like any other; repeated rows are
    judged alike.  Without anything to learn from, every document goes."""
    model = langid.train(docs.filter(fold("doc_id", 4) != 2))
    made = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    judged = langid.predict(docs, model, docs.columns, made=made)
    return judged.filter((F.col(made[0]) != "und") & (F.col(made[1]) >= LEAST_SCORE)).select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group.

    A null id comes last; of rows that repeat an id in one group, one stays.  Texts without words are one group."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a stretch of one.

    Null and empty texts leak nothing and stay.  Rows that repeat an id, null ids too, go together.  With an empty
    benchmark all stay."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars, where docs have it, becomes the number of characters (null for a null text).

    Null texts stay null, empty ones empty; every row stays, repeated ones too."""
    others = [c for c in docs.columns if c != "text"]
    made = free_name("secret_spans", docs.columns), free_name("redacted", docs.columns)
    clean = secrets.scan(docs, others, redact="[SECRET]", made=made)
    text = F.col(made[1])
    new = {"text": text.alias("text")}
    if "n_chars" in others:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return clean.select(*(new.get(c, column(c)) for c in docs.columns))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the bytes that the ids decode to, for every row.

    A null text counts as empty.  Other columns are not read."""
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, ["doc_id", "lang", "source"], made=("n_tokens", "ids", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("bpe", encode_tokens),
]

#: Not expressible in SQL: the stages are learned models, merges and connected components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := new_path(spark, name))
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
