"""Token counts of texts with a public tokenizer; the vocabulary's path is a parameter and the file is never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the byte-level vocabularies cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file of ranks, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_counts(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The rows with `n_tokens` in place of the text (0 for a null or empty text)."""
    cols = [c for c in df.columns if c not in (text, "n_tokens")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], [*b.schema.names[:-1], "n_tokens"])

    return spread(df.select(*cols, text)).mapInArrow(run, schema)
