"""Token counts by a public byte-level BPE vocabulary (read from a path, never copied or trained)."""

from __future__ import annotations

import base64
import functools
import os
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; every executor reads it from this path.
VOCABULARY = os.environ.get("SPOTWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the vocabulary's published split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The characters that ``\s`` means in the split pattern.
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space runs of this length are split here; the pattern's own engine backtracks over a run and fails at some hundred thousand characters.
LONG_RUN = 50_000


@functools.lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file; loaded once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(tokenizer, text: str, long_run: int = LONG_RUN) -> list[int]:
    """The tokens of a whole text, of any length.

    White space runs of ``long_run`` characters and more are split off as the pattern does it: all of a run but its last character, or a run at the end whole, is one stretch.
    """
    if len(text) < long_run:
        return tokenizer.encode_ordinary(text)
    out, start = [], 0
    for m in re.finditer(f"{SPACES}{{{long_run},}}", text):
        end = m.end() - (m.end() < len(text))
        out += tokenizer.encode_ordinary(text[start : m.start()])
        out += tokenizer._encode_single_piece(text[m.start() : end])
        start = end
    return out + tokenizer.encode_ordinary(text[start:])


def count_tokens(docs: DataFrame, id_: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_, n_tokens) for every row with a text; whole texts are counted, an empty one has 0 tokens.

    Rows without a text (null) are left out. The texts never leave the scan's tasks.
    """
    kind = docs.schema[id_].dataType.simpleString()

    def count(batches):
        tokenizer = encoding(vocabulary)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n_tokens": [len(encode(tokenizer, t)) for t in b["text"]]})

    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInPandas(count, f"id {kind}, n_tokens long").withColumnRenamed("id", id_)
