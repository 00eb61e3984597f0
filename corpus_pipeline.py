"""Corpus pipeline over ``documents``: clean, deduplicate, mask and pack.

Each stage takes ``(spark, docs, sf_dir)``, works on every row that its
predecessor kept and returns a DataFrame; all but the last return the columns
of ``documents``.  Rows with null or repeated ids are told apart by a row
number that follows the order of ids.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ledgerlark.llm.common import stored
from ledgerlark.llm.exact_dedup import exact_dedup
from ledgerlark.llm.language_id import Mixture
from ledgerlark.llm.packing import pack
from ledgerlark.llm.registry import tokenizer_file
from ledgerlark.llm.secret_scan import redact
from ledgerlark.llm.simhash import simhash_dedup

#: Python decides every stage (EM, XXH64 fingerprints, tokens); tests compare with brute force.
ORACLE_SQL = None

#: Least share of a kept text that is in learned languages, whichever they are.
KNOWN_SHARE = 0.3


def _kept(docs, decide, first_null):
    """Rows of ``docs`` that ``decide(docs, id column)`` keeps.

    Ids that are unique and not null are the join key; else rows get numbers
    in the order of ids, so that each row is decided on its own.  The number's
    column has a name that ``docs`` does not use.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        order = F.asc_nulls_first("doc_id") if first_null else F.asc_nulls_last("doc_id")
        docs = stored(docs.orderBy(order).withColumn(row, F.monotonically_increasing_id()), "rows")
        key = row
    else:
        key = "doc_id"
    kept = decide(docs, key).where("kept").select(F.col("doc_id").alias(key))
    return docs.join(kept, key, "left_semi").select(*[c for c in docs.columns if c != row])


def known_language(spark, docs, sf_dir):
    """Drop documents without a letter or in none of the learned languages.

    An unknown component competes with the languages in the mixture; of a kept
    text the languages together, however many, have ``KNOWN_SHARE`` at least.
    Null and empty texts go; without one labelled row all texts go, as no language
    is learned.  Repeated rows are decided alike, an empty table stays empty.
    Decided on the spot by a vectorised column, so no text is shuffled.
    """
    model = spark.sparkContext.broadcast(Mixture.fit(docs))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.known_in_parts(texts.where(texts.notna(), None).tolist()) >= KNOWN_SHARE)

    return docs.where(known("text"))


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts the row with the largest id stays.

    Null equals empty; a null id is below every other, and of rows that repeat an
    id and a text one stays.  An empty table stays empty, all columns pass through.
    """
    return _kept(docs, lambda d, key: exact_dedup(d, id_col=key), True)


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of linked fingerprints the row with the smallest id stays.

    Null and empty texts share a fingerprint; a null id is above every other, and
    of rows that repeat an id one stays.  An empty table stays empty, all columns
    pass through.
    """
    return _kept(docs, lambda d, key: simhash_dedup(d, id_col=key), False)


def mask_secrets(spark, docs, sf_dir):
    """Every document stays; each secret in its text becomes a mark.

    ``n_chars``, where the table has it, follows the text; null texts stay as they
    are, repeated rows are treated alike, an empty table stays empty.
    """
    masked = redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null text is empty and still one piece of one token; rows that repeat an id
    are packed each; an empty table gives no piece.
    """
    return pack(docs, tokenizer_file())


STAGES = [
    ("language ID", known_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage{number}")
    return docs
