"""Mixing sources to target weights: hierarchical budgeting, in DataFrame operations only.

A tree of domains, their languages and their sources holds the token capacity of each leaf (its
tokens times the epochs allowed). The budget flows down from the root: each node's share goes to its
children by weight; a child that can't use its share takes its capacity, and the rest goes to its
siblings by weight. So a shortage is made up among siblings first, and an ancestor only sees it if
all of them are short. Each leaf then takes whole epochs, and of one more epoch the documents in
seeded order until its tokens are used up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import ID_KEY, TEXT_KEY, WORD, pick, row_keys
from scrubspark.session import materialize

LEVELS = ("domain", "lang", "source")
DIGITS = 2   # hexadecimal digits of the seeded order that one look at a leaf resolves
LOOKS = 4


def word_tokens(text: Column) -> Column:
    """Tokens of a text for budgets: its words (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def pour(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Share ``budget`` (the parent's, on each row) among children by ``weight``, none over its ``capacity``.

    Integer arithmetic throughout: a child is full if its capacity is at most its share of what the
    children before it (by capacity per weight) leave; the others split the rest, rounded down.
    Children without weight get nothing.
    """
    up = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))  # siblings: a few rows of the tree
    c = children.where("weight > 0")
    order = up.orderBy((F.col("capacity") / F.col("weight")), F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    c = (c.withColumn("used", F.coalesce(F.sum("capacity").over(order), F.lit(0)))
         .withColumn("w_left", F.sum("weight").over(up) - F.coalesce(F.sum("weight").over(order), F.lit(0))))
    big = "decimal(38,0)"
    full = (F.col("capacity").cast(big) * F.col("w_left").cast(big)
            <= (F.col("budget") - F.col("used")).cast(big) * F.col("weight").cast(big))
    c = c.withColumn("full", full)
    c = (c.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(up))
         .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(up)))
    share = F.expr("cast(`left` as decimal(20,0)) * cast(weight as decimal(10,0)) div nullif(cast(w_open as decimal(20,0)), 0)")
    return c.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(share).cast("long"))


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, given`` for ``leaves (domain, lang, source, tokens)``.

    ``total`` is the budget, as an expression over ``all_tokens`` (the tokens of all leaves).
    ``weights`` gives relative integer weights by level and name; others weigh 1.
    """
    tree = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    node = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        here = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        here = here.withColumn("weight", _weight(level, weights))
        if depth:
            children = here.join(node, path[:-1])
        else:  # the root's children: a row per domain
            children = here.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).withColumn(
                "budget", F.least(total.cast("long"), F.sum("capacity").over(Window.partitionBy(F.lit(0)))))
        given = pour(children, path[:-1], level).select(*path, "tokens", "given")
        node = given.select(*path, F.col("given").alias("budget"))
    return given


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget_percent: int = 80,
        max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source") -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch`` of the selected documents, and their row keys.

    ``domain`` is an expression over the columns ``lang`` and ``source``. A null domain, language or
    source is a node named ``(none)``; a null text has no tokens. The budget is ``budget_percent``
    percent of all tokens. A leaf given q times its tokens and some more takes all documents in
    epochs 0 to q-1, and in epoch q the documents, in the order of the MD5 of
    seed:epoch:id:text-MD5, whose running sum stays within the rest. Rows that repeat id and text
    are separate documents that follow each other.
    """
    d = pick(docs, id_col, text_col, lang_col, source_col).toDF("doc_id", "text", "lang", "source")
    none = F.lit("(none)")
    d = (d.withColumn("domain", F.coalesce(domain, none)).withColumn("lang", F.coalesce("lang", none))
         .withColumn("source", F.coalesce("source", none)))
    d = materialize(d.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), *LEVELS,
                             word_tokens(F.col("text")).alias("n_tokens"),
                             F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")), "mix-docs")
    leaves = d.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    given = materialize(
        budgets(leaves, F.floor(F.col("all_tokens") * budget_percent / 100), weights, max_epochs)
        .withColumn("full", F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(1)).cast("int"))
        .withColumn("rest", F.col("given") - F.col("full") * F.col("tokens")), "mix-budgets")
    d = d.join(given.select(*LEVELS, "full", "rest"), list(LEVELS))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"),
                              F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5"))
    d = d.withColumn("place", place)
    whole = d.where("full > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"))
    # the rest: whole steps of the order by their sums, digits by digits, until few documents are left to sort
    open_, taken = d.where("rest > 0"), []
    for look in range(LOOKS):
        step = F.substring("place", look * DIGITS + 1, DIGITS)
        sums = open_.groupBy(*LEVELS, step.alias("step")).agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
        w = Window.partitionBy(*LEVELS).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        sums = materialize(sums.withColumn("upto", F.sum("t").over(w)).select(
            *LEVELS, "step", (F.col("upto") <= F.col("rest")).alias("all_in"),
            (F.col("rest") - F.col("upto") + F.col("t")).alias("still")), "mix-steps")
        marked = open_.withColumn("step", step).drop("rest").join(
            sums.where("all_in or still >= 0"), [*LEVELS, "step"]).withColumnRenamed("still", "rest")
        taken.append(marked.where("all_in").drop("step", "all_in"))
        open_ = marked.where("not all_in").drop("step", "all_in")
    w = Window.partitionBy(*LEVELS).orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = open_.withColumn("upto", F.sum("n_tokens").over(w)).where("upto <= rest").drop("upto")
    part = last
    for t in taken:
        part = part.unionByName(t)
    columns = ["doc_id", *LEVELS, "n_tokens", "epoch", ID_KEY, TEXT_KEY]
    return whole.select(*columns).unionByName(part.withColumn("epoch", F.col("full")).select(*columns))
