"""A corpus pipeline over ``documents``: language, repeated lines, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` writes each result as Parquet and reads it
back for the next. All stages but the last return the columns of documents;
other columns are not read, whatever their names. An empty table gives an
empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkspec.llm.bpe import encode
from sparkspec.llm.langid import identify, learn
from sparkspec.llm.lines import dedup_lines
from sparkspec.llm.minhash import drop_near_duplicates
from sparkspec.llm.mixing import mix, mixed_documents
from sparkspec.llm.work import Work, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Nats that the best language may cost a text beyond plain bytes: more, and the text is in none of the learned languages.
MOST_LOST = 100.0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, and those in none of the learned ones; a missing ``lang`` is filled in.

    A text is in none where the best language's code is longer than its plain
    bytes by ``MOST_LOST``. The rule looks at no other language, so it works
    for any number of them; a text in two learned languages stays. A null or empty text, and one without a letter, has no language and goes.
    Rows that repeat, or have no doc_id, are judged each by their text.
    """
    docs = docs.select(*COLUMNS)
    named = identify(docs, learn(docs)).where((F.col("lang_pred") != "und") & (F.col("saved") > -MOST_LOST))
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text by what is left of it without repeated lines; all documents stay, if need be with an empty text.

    A null text becomes empty. Rows of one doc_id count as one document when
    documents of a line are counted, a null doc_id as none.
    """
    done = dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("text_kept"))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group with five-word shingles of similarity 0.8 or more.

    Texts without words are like nothing and stay. Of rows that repeat a
    doc_id with like texts one stays; rows without a doc_id all stay.
    """
    return drop_near_duplicates(docs.select(*COLUMNS), shingle=5, percent=80, bands=34)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut and drop documents so that sources come near their targets.

    Texts without words cost nothing and stay once; rows without a source are
    a source of their own. Rows that repeat are drawn each for itself.
    """
    return mixed_documents(mix(docs.select(*COLUMNS)), COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, in rows as they come; a null or empty text has no ids."""
    return encode(docs.select("doc_id", "source", "text"), TOKENIZER).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe_tokens", bpe_tokens)]

#: Language ID and BPE are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    work = Work(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return work.table(stage(spark, docs, sf_dir), name)
