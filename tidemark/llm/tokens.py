"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files are; another folder can be given to every function here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern published with the byte-level BPE vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The tokenizer, loaded once per Python worker."""
    if (folder, name) not in _LOADED:
        import tiktoken

        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[folder, name] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[folder, name]


def with_token_counts(df: DataFrame, text: str, keep: list[str], folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of the whole text; 0 for null or empty text."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_tokens long"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            n = [len(enc.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(count, schema)
