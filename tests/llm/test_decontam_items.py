"""Benchmark items that are short, in scripts without spaces, or share an id."""

import pytest

from scrubspark.llm import decontam

CHINESE = "机器学习模型在大规模语料库上训练得到的结果非常好。"


def search(items, texts, **options):
    return decontam.Index(items, 0.8, 0.99, 11, **options).search(texts)


def test_words_by_category():
    assert decontam.words("L’été — naïve co­-op_1") == [
        w.encode() for w in ("l", "été", "naïve", "co", "op", "1")]
    assert decontam.words("ab机器cd。x") == [w.encode() for w in ("ab", "机", "器", "cd", "x")]
    assert decontam.words("हिन्दी x") == ["हिन्दी".encode(), b"x"]
    # the same whether the characters are replaced one by one or by a table
    many = "、".join("一二三四五六七八九十百千")
    assert decontam.words(many) == [c.encode() for c in "一二三四五六七八九十百千"]
    assert decontam.words("\ud800 a") == ["\ud800".encode("utf-8", "surrogatepass"), b"a"]
    assert decontam.words(None) == decontam.words("…​") == []


def test_items_without_spaces():
    edited = CHINESE.replace("大规模", "小规模")
    texts = ["今天天气很好。" + CHINESE + "我们去公园。", "今天天气很好我们去公园玩。", "开头" + edited, CHINESE[: len(CHINESE) // 2]]
    found = search([(7, CHINESE)], texts)
    assert [[y[:2] for y in f] for f in found] == [[(7, 0)], [], [(7, 1)], []]
    # the passage starts at the seventh code point, its window within twice the bound of it
    assert abs(6 - found[0][0][2]) <= 2 * decontam.edit_bound(len(decontam.words(CHINESE)))


@pytest.mark.parametrize("n", [2, 3, 4])
def test_short_items_by_exact_run(n):
    item = " ".join(["osmosis", "requires", "semipermeable", "membranes"][:n])
    other = item.rsplit(" ", 1)[0] + " lichens"
    texts = [f"note that {item.upper()}, always", f"note that {other} always", item, item[:-1], "membranes requires osmosis", None]
    found = search([(1, item)], texts)
    assert [[y[:2] for y in f] for f in found] == [[(1, 0)], [], [(1, 0)], [], [], []]
    assert search([(1, item)], texts, min_words=5) == [[]] * 6


def test_a_single_word_is_not_looked_for():
    assert search([(1, "x"), (2, "")], ["x", "y x"], min_words=0) == [[], []]


def test_items_of_one_id_count_once_over_blocks(spark):
    far, near = "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet"
    items = spark.createDataFrame([(0, far), (0, near), (0, near + " black"), (None, far), (None, near), (5, near)],
                                  "item_id long, text string")
    rows = [(1, f"{far} and {near}"), (1, f"{far} and {near}"), (1, f"{near}"), (2, f"xx {far.replace('five', '5')} yy"), (3, "none"),
            (None, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for i, t in rows:
        d = 0 if far in t or near in t else 1 if t.startswith("xx") else None
        want += [(i, k, d) for k in (0, None) if d is not None] + ([(i, 5, 0)] if near in t else [])
    for block_bytes in (1 << 20, 40, 1):
        got = decontam.contamination(docs, items, block_bytes=block_bytes)
        assert got.columns == ["doc_id", "item_id", "distance", "first_word"]
        assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == sorted(want, key=str)
        assert decontam.drop_contaminated(docs, items, block_bytes=block_bytes).count() == 1
