import hashlib
import random

import pytest
from tokenizers import Tokenizer

from scrubspark.llm import chat, queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def test_counts_equal_the_library_on_random_texts(path, library):
    r = random.Random(1)
    alphabet = " \n\t ab1'sé., 🙂ßA\x1cーĿ<|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["x<|endoftext|>y <|endoftext|>", "<|endoftext|", " a b ", "", " ", "it's 's 'll", "a" * 50_000,
              "1" * 3000, "é" * 3000, "\n" * 500, " " * 500 + "x"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.count_tokens(texts, path) == want
    assert tokens.count_tokens(texts, path, block_chars=50) == want


def test_query_equals_the_library(spark, small, library):
    d = small("documents")
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op3_token_counts"](spark, SF).collect()}
    for i, t in zip(d["doc_id"], d["text"]):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 1024)


def test_token_counts_of_odd_rows(spark, odd, odd_rows, nothing, path, library):
    got = sorted((tuple(r) for r in tokens.token_counts(odd, path).collect()), key=str)
    want = []
    for i, t, *_ in odd_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert tokens.token_counts(nothing, path).count() == 0


def test_pre_tokens_join_to_the_text():
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice(" \n\tab.é") for _ in range(30))
        assert "".join(tokens.pre_tokens(t)) == t


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_start|>", "<\\\\|x", "a<b|c", "<|<|", "\\", "\\n\n<|\\|>"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text
    assert "\n" not in chat.escape_role(text)


def brute_conversations(rows):
    out = {}
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        plain = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        formatted = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for *_, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(plain.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    return out


def test_conversations_round_trip(spark, path):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"),
            (1, 1, "assistant", None), (2, None, None, "x"), (2, 5, "sys\ntem<|", "<\\|y"), (2, 5, "sys\ntem<|", "<\\|y"),
            (None, 0, "assistant", "né 🙂"), (None, 1, "user", ""), (2**60 + 1, 0, "assistant", "long " * 20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "conv_id", "turn", "role", "text", "1 as ROLE_2").toDF("conv_id", "turn", "role", "text", "ROLE")
    got = {r[0]: tuple(r)[1:] for r in chat.formatted_digests(turns, path).collect()}
    assert got == brute_conversations(rows)


def test_ids_and_masks(spark, path):
    t, start, end = chat.tokenizer(path)
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "good <|endoftext|> bye")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns, path).orderBy("seq").collect()
    assert [r["start"] for r in out] == [0, len(out[0]["ids"])]
    assert all(r["ids"][0] == start and r["ids"].count(end) == 1 for r in out)
    assert sum(out[0]["loss_mask"]) == 0
    under = [i for i, m in zip(out[1]["ids"], out[1]["loss_mask"]) if m]
    assert chat.unescape(t.decode(under, skip_special_tokens=False)) == rows[1][3]
    assert 50256 not in out[1]["ids"]


def test_no_conversations(spark, path):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_digests(turns, path).count() == 0
