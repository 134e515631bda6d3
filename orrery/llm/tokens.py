"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, *keep, n_tokens) for each row; 0 for a null or empty text. Texts are counted whole, whatever their length.

    The vocabulary file is read on the driver and carried to the tasks."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    keep = keep or []
    src = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in pdf["__text"]]
            yield pdf.drop(columns="__text").assign(n_tokens=pd.Series(n, index=pdf.index, dtype="int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("__text").schema.fields) + ", n_tokens long"
    return spread(src).mapInPandas(run, schema)
