"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter of the driver's, which sends it
with the job; nothing is trained."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, spread

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of that byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoding of a rank file, loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), path: str = RANKS) -> DataFrame:
    """(id, n_tokens, *keep), written once: whole texts are tokenised in the scan's tasks and only their
    sizes go on. A null or empty text has 0 tokens; a null id is left out; a repeated id keeps each row."""
    kinds = dict(df.dtypes)
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    rows = spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text_"), *keep))
    schema = ", ".join(["id long", "n_tokens long", *[f"`{c}` {kinds[c]}" for c in keep]])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(SparkFiles.get(name))
        for pdf in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in pdf["text_"]]
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": sizes, **{c: pdf[c] for c in keep}})

    return cut(rows.mapInPandas(count, schema))
