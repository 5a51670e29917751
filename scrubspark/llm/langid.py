"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all labelled documents, or from a bounded, seeded sample of them where a caller sets
its size; the log-probability matrix (languages x buckets, a fixed size per language) is broadcast, and
texts are scored in numpy, batch by batch, touching only the buckets that a text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import pick
from scrubspark.session import materialize

ORDERS = 3               # n-grams of 1, 2 and 3 characters
BUCKETS = 1 << 16
PIECE = 1 << 18          # characters worked on at once
MAX_LANGS = 1024         # 256 MB of log-probabilities; more raises
TRAIN_DOCS_PER_LANG = 5_000
UNKNOWN = "und"
FLOOR_SHARE = 0.01       # of the documents that a language's least mean log-likelihood is read off
SKETCH = 10_000          # accuracy of the quantiles that bracket the exact one
MIN_FLOOR_DOCS = 100     # languages with fewer take the quantile of all
MARGIN, SPREAD = 0.3, 12.0  # below that quantile a text of n n-grams may still lie by MARGIN + SPREAD / sqrt(n)


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of about PIECE characters: text numbers, and segments ending in ORDERS-1 characters of context."""
    ids, parts, size = [], [], 0
    for i, t in enumerate(texts):
        t = t.lower()
        for at in range(0, len(t), PIECE):
            part = t[at: at + PIECE + ORDERS - 1]
            part += "\0" * (min(PIECE, len(t) - at) + ORDERS - 1 - len(part))
            ids.append(i)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield ids, parts
                ids, parts, size = [], [], 0
    if ids:
        yield ids, parts


def _grams(parts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams starting at each character, per order (BUCKETS where context starts), and part starts."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate((code, np.zeros(ORDERS - 1, np.uint32)))
    size = int(lens.sum())
    outside = np.concatenate([starts + lens - d for d in range(1, ORDERS)])
    out, h = [], np.zeros(size, np.uint32)
    for n in range(ORDERS):
        h = (h + code[n: n + size] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        bucket = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32)
        bucket[outside] = BUCKETS
        out.append(bucket)
    return out, starts


@dataclass
class Model:
    """``langs`` (sorted) and float32 ``logp`` (languages x BUCKETS + 1, last column 0), ``prior``, and
    ``floor``: the least mean log-likelihood of an n-gram by language (None: any will do)."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray
    floor: np.ndarray | None = None

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text by language, with the prior, and its number of n-grams."""
        total, n = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts))
        for ids, parts in _pieces(texts):
            grams, starts = _grams(parts)
            for g in grams:
                np.add.at(n, ids, np.add.reduceat(g < BUCKETS, starts, dtype=np.float64))
            for k in range(len(self.langs)):
                row = self.logp[k]
                for g in grams:
                    np.add.at(total, (ids, k), np.add.reduceat(row[g], starts, dtype=np.float64))
        return total, n

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best language number and its posterior for each text; the posterior is 0 where the text is unlikely in it."""
        total, n = self.totals(texts)
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        p = 1.0 / odds.sum(axis=1)
        if self.floor is not None:
            n = np.maximum(n, 1)
            mean = (total[np.arange(len(texts)), best] - self.prior[best]) / n
            p[mean < self.floor[best] - MARGIN - SPREAD / np.sqrt(n)] = 0.0
        return best, p


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(labelled: DataFrame, docs_per_lang: int | None = TRAIN_DOCS_PER_LANG, alpha: float = 0.5) -> Model | None:
    """Learn from ``labelled (id, text, lang)``; rows without a language or text teach nothing.

    About ``docs_per_lang`` documents of each language are read (chosen by a seeded hash of the id; None: all),
    whole; priors come from all of them. None if there is nothing to learn from.
    """
    d = pick(labelled, "id", "text", "lang").where("lang is not null and text is not null")
    n_of = {r[0]: r[1] for r in d.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if not n_of:
        return None
    if len(n_of) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages: the broadcast matrix would have no useful bound")
    langs = sorted(n_of)
    if docs_per_lang is not None:
        share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n_of[k])))])
        u = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("langid")), F.lit(1 << 30)) / (1 << 30)
        d = d.where(u < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                c = seen.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for _, parts in _pieces(list(texts)):
                    for g in _grams(parts)[0]:
                        c += np.bincount(g, minlength=BUCKETS + 1)
        for lang, c in seen.items():
            at = np.flatnonzero(c[:BUCKETS])
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    counts = (d.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # at most MAX_LANGS x BUCKETS rows
    c = np.zeros((len(langs), BUCKETS))
    c[np.searchsorted(langs, counts["lang"].to_numpy(str)) if len(counts) else [], counts["bucket"]] = counts["n"]
    logp = np.log(c + alpha) - np.log((c + alpha).sum(axis=1, keepdims=True))
    n = np.array([n_of[k] for k in langs], float)
    return Model(langs, np.hstack([logp, np.zeros((len(langs), 1))]).astype(np.float32), np.log(n / n.sum()))


def floors(labelled: DataFrame, model: Model) -> np.ndarray | None:
    """Per language of ``model``, the FLOOR_SHARE quantile of the mean log-likelihood of its n-grams in that
    language's own documents, from all of ``labelled (id, text, lang)``, on which ``model`` wasn't fitted."""
    d = pick(labelled, "id", "text", "lang").where(F.col("lang").isin(model.langs) & F.col("text").rlike(r"\p{L}"))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            total, n = m.totals(list(pdf["text"]))
            k = np.searchsorted(m.langs, pdf["lang"].to_numpy(str))
            yield pd.DataFrame({"lang": pdf["lang"], "mean": (total[np.arange(len(pdf)), k] - m.prior[k]) / np.maximum(n, 1)})

    found = _quantiles(materialize(d.select("lang", "text").mapInPandas(means, "lang string, mean double"),
                                   "langid-means"), FLOOR_SHARE)
    q = {k: v for k, (n, v) in found.items() if k is None or n >= MIN_FLOOR_DOCS}
    return np.array([q.get(k, q[None]) for k in model.langs]) if None in q else None


def _quantiles(scored: DataFrame, p: float) -> dict[str | None, tuple[int, float]]:
    """Rows and exact ``p`` quantile (the value of rank ceil(p * rows)) of ``scored (lang, mean)`` by language,
    and of all rows under None.

    Sketched quantiles on both sides bracket the rank. Values under the bracket are counted, only the distinct
    ones within it are ranked; a bracket that misses its rank is tried again, wider.
    """
    each = scored.select(F.explode(F.array("lang", F.lit(None))).alias("lang"), "mean")
    margin = 3.0 / SKETCH
    while True:
        at = F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin)))
        b = each.groupBy(F.col("lang").alias("of")).agg(
            F.count("*").alias("n"), F.percentile_approx("mean", at, SKETCH).alias("ends"))
        cells = each.join(F.broadcast(b), F.col("lang").eqNullSafe(F.col("of"))).where("mean <= ends[1]").groupBy(
            "lang", "n", F.when(F.col("mean") >= F.col("ends")[0], F.col("mean")).alias("v")).agg(F.count("*").alias("c"))
        upto = Window.partitionBy("lang").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        found = cells.withColumn("cum", F.sum("c").over(upto)).groupBy("lang", "n").agg(F.min(F.when(
            F.col("cum") >= F.ceil(F.col("n") * p), F.struct("cum", "v"))).alias("first")).collect()  # a row per language
        if margin >= 1 or all(r["first"] is not None and r["first"].v is not None for r in found):
            return {r.lang: (r.n, r["first"].v) for r in found}
        margin *= 10


def predict_column(spark, model: Model | None, text: Column) -> Column:
    """``struct<lang_pred string, score double>`` of a text column: a learned language, or ``und`` with
    score 0 for a null text, a text without a letter, or if nothing was learned."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        known = np.flatnonzero([has_letter(t) for t in texts])
        if len(known):
            best, p = m.score([texts.iloc[i] for i in known])
            lang[known], score[known] = np.array(m.langs, object)[best], p
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict(text)


def held_out_column(doc_id: Column) -> Column:
    """Every fifth document by the CRC-32 of its id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, text, held_out, lang_pred, score`` for each row of ``docs``, learned from the rows not held out."""
    d = pick(docs, id_col, text_col, lang_col).toDF("id", "text", "lang").withColumn(
        "held_out", held_out_column(F.col("id")))
    model = fit(d.where(~F.col("held_out")))
    p = predict_column(docs.sparkSession, model, F.col("text"))
    return d.select(F.col("id").alias("doc_id"), "text", "held_out", p.alias("p")).select(
        "doc_id", "text", "held_out", "p.lang_pred", "p.score")


def drop_unidentified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents whose language can't be told: ``und``, a posterior under ``min_score``, or
    n-grams that are unlikely even in the best language, by the labelled documents that are held out.

    All labelled documents count: those not held out in the model, the others in its floors."""
    d = pick(docs, id_col, text_col, lang_col).toDF("id", "text", "lang")
    model = fit(d.where(~held_out_column(F.col("id"))), docs_per_lang=None)
    if model is not None:
        model.floor = floors(d.where(held_out_column(F.col("id"))), model)
    cols = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    p = predict_column(docs.sparkSession, model, F.col(f"_c{cols.index(text_col)}"))
    kept = flat.withColumn("__p", p).where((F.col("__p.lang_pred") != UNKNOWN) & (F.col("__p.score") >= min_score))
    return kept.drop("__p").toDF(*cols)
