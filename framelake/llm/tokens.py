"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The default vocabulary: byte-level BPE for many languages.
VOCABULARY = os.environ.get("FRAMELAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

#: Fixed value: the splitting pattern that belongs to byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""



@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as held:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in held if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; a null or empty text has none."""
    encode = encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def tokens_within(ids: list[int], size: int, path: str) -> int:
    """How many tokens begin within the first ``size`` bytes of their text."""
    enc, held = encoding(path), 0
    for n, token in enumerate(ids):
        if held >= size:
            return n
        held += len(enc.decode_single_token_bytes(token))
    return len(ids)


def with_token_counts(documents: DataFrame, prompt_of=None, path: str | None = None) -> DataFrame:
    """``doc_id, source, tokens, prompt_tokens`` of whole texts, in Arrow batches.

    ``prompt_of`` gives the beginning of a text that bears no loss; ``prompt_tokens`` are the whole text's tokens that
    begin in it, 0 where it is None. Null and empty texts have 0 tokens. Null ids and sources stay null.
    """
    path = path or VOCABULARY
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64()), ("prompt_tokens", pa.int64())])

    def run(batches):
        encode = encoding(path).encode_ordinary
        for batch in batches:
            whole, prompts = [], []
            for text in batch.column(2).to_pylist():
                ids = encode(text) if text else []
                whole.append(len(ids))
                prompts.append(tokens_within(ids, len(prompt_of(text).encode("utf-8", "surrogatepass")), path) if prompt_of and text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.int64()), pa.array(prompts, pa.int64())], schema=out)

    return documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint, prompt_tokens bigint")
