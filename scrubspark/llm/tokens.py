"""Token counts without token ids.

A text is cut into pre-tokens at places where the tokenizer's own pre-tokenizer always cuts: before
a single space between two non-space characters (its pattern takes a space together with what
follows, and nothing but a space ever crosses into a word). Within a block of documents each
distinct pre-token is encoded once, and its number of pieces is joined to the pre-token frequencies
of each document and summed. The numbers are kept between blocks, up to a fixed number of entries.
"""

from __future__ import annotations

import gc
import json
import re
from collections import Counter
from operator import mul

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import pick

CACHE_ENTRIES = 1_500_000
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: a space, Latin letters, and at most one mark: one word for the model, and one token for the mark
_WORD = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,;:!?]?)")
#: byte-level alphabets write the bytes that are no printable characters as 256, 257, ... in order
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_SPACE = chr(_ALPHABET[32])

_LOADED: dict[str, tuple] = {}


def tokenizer(path: str):
    """The tokenizer, its special strings and their pattern, and the piece counts so far (one each per Python worker)."""
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        special = [a.content for a in t.get_added_tokens_decoder().values()]
        cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        _LOADED[path] = (t, special, cut, {})
    return _LOADED[path]


def pre_tokens(text: str) -> list[str]:
    """Pieces whose concatenation is the text; all but the first begin with the space they were cut at."""
    # if all white space is single spaces and newlines inside, each space is a cut
    plain = text.count(" ") + text.count("\n") == len(text.split()) - 1
    parts = text.split(" ") if plain else _CUT.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


def _count_pieces(new: list[str], t) -> list[int]:
    """Tokens of each distinct pre-token: plain words by the model alone, others by the whole tokenizer."""
    pre = json.loads(t.pre_tokenizer.__getstate__()) if t.pre_tokenizer is not None else {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and t.normalizer is None
    out, rest, model = [0] * len(new), [], t.model
    for i, p in enumerate(new):
        m = _WORD.fullmatch(p) if plain else None
        if m:
            word = (m[1].replace(" ", _SPACE) if p.isascii() else
                    m[1].encode().decode("latin-1").translate(_ALPHABET))
            out[i] = len(model.tokenize(word)) + len(m[2])
        else:
            rest.append(i)
    for at in range(0, len(rest), 10_000):
        part = rest[at: at + 10_000]
        for i, e in zip(part, t.encode_batch_fast([new[i] for i in part], add_special_tokens=False)):
            out[i] = len(e)
    return out


def count_tokens(texts: list[str], path: str, block_chars: int = 1 << 22) -> list[int]:
    """Tokens of each text, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""
    collecting = gc.isenabled()
    gc.disable()  # millions of strings live on in the cache, none of them in cycles
    try:
        return _count(texts, path, block_chars)
    finally:
        if collecting:
            gc.enable()


def _count(texts: list[str], path: str, block_chars: int) -> list[int]:
    t, special, cut, pieces = tokenizer(path)
    out: list[int] = []
    block: list[Counter] = []

    def flush() -> None:
        if len(pieces) > CACHE_ENTRIES:
            pieces.clear()
        new = list(set().union(*block) - pieces.keys())
        pieces.update(zip(new, _count_pieces(new, t)))
        out.extend(sum(map(mul, c.values(), map(pieces.__getitem__, c))) for c in block)
        block.clear()

    chars = 0
    for text in texts:
        c: Counter = Counter()
        for part in (cut.split(text) if any(x in text for x in special) else [text]):
            if part:
                c.update([part] if part in special else pre_tokens(part))
        block.append(c)
        chars += len(text)
        if chars >= block_chars:
            flush()
            chars = 0
    flush()
    return out


def n_tokens_column(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(["" if t is None else t for t in texts], path), dtype="int64")

    return n_tokens(text)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)``, one row per row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows keep their rows.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    counted = d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       n_tokens_column(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
