"""Source divergence audit: how far the word use of each source lies from every other of its language.

Counts of terms by (language, source) are pre-aggregated in each task, then summed by Spark. The
comparison of all sources is a cube: a cell is (group block, group block, term block) of one language,
and one task owns it. The slice of a group block and a term block is replicated to the cells that share
it, a cell sums the divergences of its groups over its terms, and the partial sums are added along
the term axis. Terms that no group of a cell has are not sent there: each pair adds their number times
the value that two zero counts give. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import pick
from scrubspark.session import materialize

SCALE = 1_000_000_000      # shares are counted in parts of this
MIN_DOCS = 3               # documents of a language that a kept term stands in, at least
GROUP_BLOCK = 128          # groups of a block, about
TERM_BLOCK = 8192          # terms of a block, about
TERMS_HELD = 500_000       # distinct (group, term) counts a task holds before it passes them on
TOP_TERMS = 200

#: Letters A-Z are lowered; other ASCII characters part terms, all others belong to them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` (occurrences; documents that hold the term), pre-aggregated by task.

    ``docs``: lang, source, text without nulls.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        inside: dict = defaultdict(Counter)

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                names = list(terms)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(names), pa.string()),
                    "source": pa.array([source] * len(names), pa.string()),
                    "term": pa.array(names, pa.binary()).cast(pa.string()),
                    "n": pa.array([terms[t] for t in names], pa.int64()),
                    "docs": pa.array([inside[lang, source][t] for t in names], pa.int64())})
            n.clear()
            inside.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                terms = text.translate(_FOLD).split()
                n[lang, source].update(terms)
                inside[lang, source].update(set(terms))
            if sum(map(len, n.values())) > TERMS_HELD:
                yield from emit()
        yield from emit()

    partial = docs.select("lang", "source", "text").mapInArrow(
        count, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, (total + terms).cast("decimal(20,0)"))


def _excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): p and q are at most SCALE + 1, so that the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit_tables(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                 min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """``counts`` (lang, source, term, n, p, q) of kept terms and ``groups`` (lang, source, total, terms, p_none).

    Null lang, source and text read as ''. p is the share of a term in its group, q in its language; p_none
    is that of a kept term the group doesn't have. Groups without any kept term are among the groups.
    """
    d = pick(docs, lang_col, source_col, text_col).toDF("lang", "source", "text")
    d = d.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(term_counts(d), "term-counts")
    by_lang = (counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
               .where(F.col("docs") >= min_docs).drop("docs"))
    kept = materialize(counts.select("lang", "source", "term", "n").join(by_lang, ["lang", "term"]), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_distinct("term").alias("terms"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (d.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left")
              .join(of_lang, "lang", "left")
              .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"),
                      F.coalesce("total_lang", zero).alias("total_lang")))
    groups = materialize(groups.withColumn(
        "p_none", F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.col("terms"))).otherwise(F.lit(1))), "groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"))
    return shares, groups


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of one cell: every ordered pair of its two group blocks, over its terms."""
    none = rows["term"].isna().to_numpy()
    marks, shares = rows[none], rows[~none]
    low, high = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    names = marks["source"].to_numpy(object)
    block = marks["block"].to_numpy()
    p_none, total = marks["p"].to_numpy(np.int64), int(marks["n_terms"].iloc[0])
    number = {s: i for i, s in enumerate(names)}
    term, distinct = pd.factorize(shares["term"])
    share = np.repeat(p_none[:, None], len(distinct), axis=1)
    share[shares["source"].map(number).to_numpy(np.int64), term] = shares["p"].to_numpy(np.int64)
    unseen = total - len(distinct)
    source, item, value = [], [], [np.empty(0, np.int64)]
    for i in range(len(names)):
        # a pair of blocks once: within one block each ordered pair, between two both directions
        others = np.flatnonzero((block == (high if block[i] == low else low)) & (np.arange(len(names)) != i))
        q, q_none = share[others], p_none[others]
        value.append(((share[i] - q) ** 2 // q).sum(axis=1) + unseen * ((p_none[i] - q_none) ** 2 // q_none))
        source += [names[i]] * len(others)
        item += names[others].tolist()
    lang = [rows["lang"].iloc[0]] * len(item)
    return pd.DataFrame({"lang": lang, "source": source, "item": item, "value": np.concatenate(value)}).astype(
        {"lang": object, "source": object, "item": object})


def pair_divergences(shares: DataFrame, groups: DataFrame, group_block: int = GROUP_BLOCK,
                     term_block: int = TERM_BLOCK) -> DataFrame:
    """``lang, source, item, value``: each source of a language against each other one, over all kept terms."""
    size = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.max("terms").alias("n_kept"))
    blocks = size.select("lang", F.ceil(F.col("n_groups") / group_block).cast("int").alias("by_group"),
                         F.greatest(F.lit(1), F.ceil(F.col("n_kept") / term_block)).cast("int").alias("by_term"))

    def place(name: str, count: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col(count)).cast("int")

    marks = groups.join(blocks, "lang").select(
        "lang", "source", "by_group", "by_term", place("source", "by_group").alias("block"), F.col("p_none").alias("p"),
        F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), F.col("by_term") - 1)).alias("slab"))
    # the number of kept terms in each term block: terms once by language, not once a group
    in_slab = (shares.select("lang", "term").distinct().join(blocks, "lang")
               .groupBy("lang", place("term", "by_term").alias("slab")).agg(F.count("*").alias("n_terms")))
    marks = marks.join(in_slab, ["lang", "slab"], "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    slices = shares.join(blocks, "lang").select(
        "lang", "source", "by_group", "by_term", place("source", "by_group").alias("block"), "p", "term",
        place("term", "by_term").alias("slab"), F.lit(0).cast("long").alias("n_terms"))
    other = F.explode(F.sequence(F.lit(0), F.col("by_group") - 1))
    cells = marks.select(*slices.columns).unionByName(slices).withColumn("other", other).select(
        "lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "slab", "source",
        "block", "term", "p", "n_terms")
    partial = cells.groupBy("lang", "lo", "hi", "slab").applyInPandas(
        _cell, "lang string, source string, item string, value bigint")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence_audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                     min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources, and the terms a source uses most above its language.

    Terms are runs of ASCII letters (lowered) and other non-ASCII characters; a language keeps those in
    at least ``min_docs`` of its rows. Part ``pair``: every other source of the language by divergence, all
    of them; part ``term``: kept terms of the group with a share above that of the language, the first
    ``top_terms``. Ranks count from 1, value descending, then item by its UTF-8 bytes. Null lang, source
    and text read as '' (a group like others); repeated rows count each; a table without rows gives none.
    """
    shares, groups = audit_tables(docs, lang_col, source_col, text_col, min_docs)
    shares = materialize(shares, "shares")
    pairs = pair_divergences(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = shares.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _excess(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(by))
    top = above.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
    return ranked.unionByName(top)
