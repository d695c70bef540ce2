"""What the corpus operators share: words, held-out rows, joins by document, checked broadcasts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.workspace import Workspace, ship

__all__ = ["BROADCAST_ROWS", "CACHED_BYTES", "WORD", "Workspace", "crc_mod", "held", "same_row", "ship", "small", "tokenizer_path", "words_count"]

#: ASCII white space; words are maximal runs of anything else. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: A side with at most so many narrow rows (a key and a few numbers each) is broadcast; its rows are counted first.
BROADCAST_ROWS = 100_000
#: Longer words are not remembered between documents, so that a memory bounded in entries is bounded in bytes.
CACHED_BYTES = 64


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small, else as it is. df should be a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_key): docs' rows as structs, beside what they are joined by; their other names then can't clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("text_key"))


def same_row(a: str, b: str) -> Column:
    """Equal ids, null or not, and text hashes."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def words_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
