"""Queries ``opN_<name>`` over the test tables, with their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..session import spread
from . import bpe as _bpe
from . import embedding_dedup as _embedding
from . import exact_dedup as _exact
from . import language_id as _language
from . import licence_scan as _licence
from . import packing as _packing
from . import secret_scan as _secrets
from . import simhash as _simhash
from . import suffix_dedup as _suffix
from . import toxicity as _toxicity


def _table(spark, sf_dir, name):
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary; ``LEDGERLARK_TOKENIZERS`` names another folder."""
    folder = os.environ.get("LEDGERLARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark, sf_dir):
    docs, path = _table(spark, sf_dir, "documents"), tokenizer_file()
    return _bpe.round_trip(docs, path, _bpe.compile_lexicon(docs, path))


def op2_toxicity(spark, sf_dir):
    return _toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secret_scan(spark, sf_dir):
    return _secrets.secret_scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op4_suffix_dedup(spark, sf_dir):
    out = _suffix.suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_best_fit_packing(spark, sf_dir):
    return _packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file())


def op6_language_id(spark, sf_dir):
    return _language.language_id(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark, sf_dir):
    return _simhash.simhash_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op8_exact_dedup(spark, sf_dir):
    return _exact.exact_dedup(_table(spark, sf_dir, "documents")).drop("bucket", "chain")


def op9_licence_scan(spark, sf_dir):
    return _licence.licence_scan(_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark, sf_dir):
    return _embedding.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def queries():
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_toxicity, op3_secret_scan, op4_suffix_dedup, op5_best_fit_packing, op6_language_id, op7_simhash_near_dedup, op8_exact_dedup, op9_licence_scan, op10_embedding_near_dedup)}


def oracle_sql():
    return {"op8_exact_dedup": _exact.ORACLE, "op9_licence_scan": _licence.oracle(), "op10_embedding_near_dedup": _embedding.ORACLE}
