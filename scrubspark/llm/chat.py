"""Chat formatting by token-level assembly.

Each segment of a turn (its head, its text) is encoded on its own, so that no text can ever produce
a reserved id; the reserved ids of the turn marks are spliced in between. The loss mask comes from
prefix sums of segment lengths: +1 where a trained text starts, -1 where it ends. Control strings
inside texts are escaped reversibly, so that the decoded string can be parsed as well.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import pick
from scrubspark.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

_LOADED: dict[str, tuple] = {}


def tokenizer(path: str):
    """The tokenizer (its own special strings read as ordinary text) and the ids of the two marks, just past its own."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True
        n = t.get_vocab_size(with_added_tokens=True)
        _LOADED[path] = (t, n, n + 1)
    return _LOADED[path]


def escape(text: str) -> str:
    r"""``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|``, and so on: no ``<|`` is left."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``; line ends, which would end the head, are written as backslash n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def assemble(roles: list[str], texts: list[str], path: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Token ids and loss mask (0 or 1 per token) of each turn."""
    t, start, end = tokenizer(path)

    def encode(parts: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(parts, add_special_tokens=False)]

    kinds = list(dict.fromkeys(roles))
    head_of = dict(zip(kinds, encode([escape_role(r) + "\n" for r in kinds])))
    heads, bodies = [head_of[r] for r in roles], encode([escape(x) for x in texts])
    tail = encode(["\n"])[0]
    segments = [x for h, b in zip(heads, bodies) for x in ([start], h, b, [end], tail)]
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    edge = np.concatenate(([0], np.cumsum(lengths)))           # where each segment starts
    body = np.arange(len(roles)) * 5 + 2
    trained = np.array([r == TRAINED for r in roles], bool)
    step = np.zeros(edge[-1] + 1, np.int64)
    np.add.at(step, edge[body[trained]], 1)
    np.add.at(step, edge[body[trained] + 1], -1)
    mask = np.cumsum(step[:-1]).astype(np.int8)
    ids = np.fromiter((i for s in segments for i in s), np.int32, int(edge[-1]))
    cuts = edge[5:-1:5]
    return np.split(ids, cuts), np.split(mask, cuts)


def format_conversations(turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, seq, start, ids, loss_mask``: one row per turn, in conversation order.

    ``start`` is the token offset of the turn in its conversation; the conversation's ids are those
    of its turns one after the other. Turns go by ``turn`` (nulls first), ties by role, then text.
    Null roles and texts count as empty; rows of a null conversation id form one conversation;
    repeated rows are repeated turns.
    """
    d = pick(turns, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    d = d.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))

    @F.pandas_udf("ids array<int>, loss_mask array<byte>")
    def encode(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        ids, masks = [], []
        for at in range(0, len(texts), 1024):
            i, m = assemble(roles.iloc[at: at + 1024].tolist(), texts.iloc[at: at + 1024].tolist(), path)
            ids += i
            masks += m
        return pd.DataFrame({"ids": ids, "loss_mask": masks})

    # texts are encoded where they are read; only then do the turns of a conversation meet
    done = d.withColumn("e", encode("role", "text")).select("conv_id", "turn", "role", "text", "e.ids", "e.loss_mask",
                                                            F.size("e.ids").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return done.select("conv_id", F.row_number().over(w).cast("long").alias("seq"),
                       F.coalesce(before, F.lit(0)).cast("long").alias("start"), "ids", "loss_mask")


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """``conv_id, seq, role, text, trained, chars``: the turns as parsed from ids and mask.

    ``trained`` is the text under the mask (null if none of the turn is), ``chars`` the length of
    the turn's decoded string.
    """
    @F.pandas_udf("role string, text string, trained string, chars long")
    def decode(ids: pd.Series, masks: pd.Series) -> pd.DataFrame:
        t, start, end = tokenizer(path)
        plain, under, lead = [], [], []
        for i, mask in zip(ids, masks):
            first, last = np.flatnonzero(i == start), np.flatnonzero(i == end)
            if len(first) != 1 or len(last) != 1 or first[0] != 0:
                raise ValueError("a turn needs one start mark in front and one end mark")
            plain.append(i[1: last[0]].tolist())
            lead.append(i[last[0] + 1:].tolist())
            under.append(i[mask.astype(bool)].tolist())
        inner, after, trained = (t.decode_batch(x, skip_special_tokens=False) for x in (plain, lead, under))
        heads = [x.partition("\n") for x in inner]
        roles = [unescape_role(h[0]) for h in heads]
        return pd.DataFrame({
            "role": roles, "text": [unescape(h[2]) for h in heads],
            "trained": [unescape(x) if x or r == TRAINED else None for r, x in zip(roles, trained)],
            "chars": [len(START) + len(x) + len(END) + len(y) for x, y in zip(inner, after)]})

    return formatted.withColumn("d", decode("ids", "loss_mask")).select("conv_id", "seq", "d.*")


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back``'s turns: counts and running SHA-256 digests.

    Turns stream through the task in order; what a task holds does not grow with a conversation.
    """
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_, state = None, False, None
        for pdf in batches:
            rows = []
            for conv, role, text, trained, chars in pdf[["key", "role", "text", "trained", "chars"]].itertuples(
                    index=False, name=None):
                if not open_ or conv != key:
                    if open_:
                        rows.append(_closed(key, state))
                    key, open_, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if trained is not None:
                    state[2] += len(trained)
                    state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[4] += chars
            if rows:
                yield _frame(rows)
        if open_:
            yield _frame([_closed(key, state)])

    keyed = parsed.withColumn("key", F.col("conv_id").cast("string"))  # a nullable number would turn float in pandas
    return (keyed.repartition("key").sortWithinPartitions("key", "seq")
            .select("key", "role", "text", "trained", "chars")
            .mapInPandas(digest, "key string, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")
            .select(F.col("key").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars",
                    "loss_sha256", "formatted_chars"))


def _closed(key, s) -> tuple:
    return key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                       "formatted_chars"])


def formatted_digests(turns: DataFrame, path: str, **columns: str) -> DataFrame:
    """Format, write, read the written ids back, and digest them per conversation."""
    written = materialize(format_conversations(turns, path, **columns), "chat")
    return conversation_digests(read_back(written, path))
