"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
_PIECE = 100_000  # letters encoded at once, about


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def batches(it):
        encoder, pattern = _encoder(path), regex.compile(PATTERN)

        def size(text: str | None) -> int:
            if not text:
                return 0
            if len(text) <= _PIECE:
                return len(encoder.encode_ordinary(text))
            # in pieces that end where a match of the pattern ends, so that the tokens are those of the whole
            n = at = 0
            for m in pattern.finditer(text):
                if m.end() - at >= _PIECE:
                    n += len(encoder.encode_ordinary(text[at : m.end()]))
                    at = m.end()
            return n + len(encoder.encode_ordinary(text[at:]))

        for batch in it:
            kept = [i for i, c in enumerate(batch.schema.names) if c not in ("text", "tokens")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array([size(x) for x in batch.column("text").to_pylist()], pa.int64())], names=[*(batch.schema.names[i] for i in kept), "tokens"])

    return batches


def token_sizes(df: DataFrame, folder: str = FOLDER, tokenizer: str = TOKENIZER) -> DataFrame:
    """All columns but ``text``, and ``tokens``, its size, in place of any column of that name; null and empty texts have none."""
    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in ("text", "tokens"))
    return df.mapInArrow(_count(f"{folder}/{tokenizer}"), f"{kept}, tokens long")
