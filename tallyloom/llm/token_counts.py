"""Token counts (4): pre-tokens proved to be one token are counted directly, the rest is merged."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_bpe
from .common import doc_rows, spread, table


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text, as the tokenizers library counts them without added tokens.

    A null text is empty and has no tokens; ids may be null or repeat, each row gets its answer. The proof runs once on
    the driver; its result, at most one string for each vocabulary entry, travels with the function.
    """
    whole = frozenset(word_bpe.load(tokenizer).whole_tokens())

    def run(batches):
        counter = word_bpe.counter(tokenizer, whole)
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = doc_rows(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return spread(docs.sparkSession, rows).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
