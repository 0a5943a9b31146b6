"""Sizes of texts in tokens of a public tokenizer, read from a file that is named by a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the rank files' vocabularies split a text before they merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """How many tokens each of some texts has; strings of special tokens are ordinary text."""
    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))  # shipped with addFile
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(x.ids) for k in range(0, len(texts), 256) for x in tokenizer.encode_batch(texts[k : k + 256], add_special_tokens=False)]


def _sizes(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns=["text"])
            out["tokens"] = _counter(path)(["" if t is None else t for t in b["text"]])
            yield out

    return run


def token_sizes(documents: DataFrame, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, *keep, tokens``: the size of each document's whole text; 0 for a null or empty one.

    ``tokenizer`` names a rank file (``.tiktoken``) or a tokenizer's JSON file, on every machine or shipped with ``addFile``.
    """
    chosen = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name in keep)
    # Texts are small to read and slow to tokenize: spread them over all cores first.
    spread = chosen.repartition(max(2 * documents.sparkSession.sparkContext.defaultParallelism, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "doc_id")
    return spread.mapInPandas(_sizes(tokenizer), f"doc_id long{kept}, tokens long")
