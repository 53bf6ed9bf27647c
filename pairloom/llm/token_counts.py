"""Token counts by a public tokenizer.

The library encodes batches inside an Arrow function that returns lengths
only.  Batches are filled by UTF-8 bytes, not by rows, and a long text is cut
where the pre-tokenizer always cuts too: before a single space between two
letters, and between a letter and an East Asian punctuation mark.  The parts'
counts then add up to the text's count.  Whether a tokenizer may be fed parts
is read from its own definition: byte-level pieces by the usual pattern, no
normaliser, no prefix space, and added tokens without blanks that take no
neighbouring white space; texts for all other tokenizers stay whole.

Defined results: null counts as the empty text (0 bytes, 0 tokens); repeated
rows are counted each; an empty table gives an empty table; extra columns of
any name are passed by, and the count takes the first free name.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

#: Characters of one piece, and UTF-8 bytes of all pieces encoded by one call.
PIECE_CHARS = 32_768
BATCH_BYTES = 262_144
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])|(?<=[^\W\d_])(?=[\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20])")


def tokenizer_path(name: str) -> str:
    """A path stays as it is; a bare name is looked up among the public vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def divisible(definition: dict) -> bool:
    """Whether the counts of a text's pieces add up, by the tokenizer's definition."""
    steps = definition.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    plain = len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex", True) and not steps[0].get("add_prefix_space", True)
    added = all(not t["lstrip"] and not t["rstrip"] and " " not in t["content"] for t in definition.get("added_tokens") or [])
    return bool(plain and added and not definition.get("normalizer"))


@lru_cache(maxsize=2)
def _encoder(name: str):
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), divisible(json.loads(model.to_str()))


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` in parts of about ``size`` characters, cut at safe boundaries only."""
    out, at = [], 0
    while len(text) - at > size:
        found = _CUT.search(text, at + max(size, 2) - 1)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def count_tokens(texts: list[str | None], name: str) -> list[int]:
    encode, in_pieces = _encoder(name)
    counts = [0] * len(texts)
    batch: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for owner, n in zip(owners, encode(batch) if batch else [], strict=True):
            counts[owner] += n
        batch.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for part in (pieces(text) if in_pieces else [text]) if text else []:
            size = len(part.encode("utf-8", "surrogatepass"))
            if held and held + size > BATCH_BYTES:
                flush()
            batch.append(part)
            owners.append(i)
            held += size
    flush()
    return counts


def with_token_counts(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", name: str = "n_tokens") -> DataFrame:
    """``docs`` plus a long column ``name``, or the first free ``name_N``."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts.to_pylist(), tokenizer), pa.int64())

    return docs.withColumn(free_name(docs, name), lengths(F.col(text)))


def token_count_rows(docs: DataFrame, limit: int = 512) -> DataFrame:
    """The contract's columns, one row a document."""
    counted = with_token_counts(docs.select("doc_id", "text"))
    return counted.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
