"""Quality rules: robust multivariate outliers, in DataFrame operations only.

Each text gives a vector of transformed statistics (mean word length, symbols per word, share of
repeated lines, share of repeated words). Per language and source, the minimum covariance
determinant of half of the distinct texts is approached by C-steps from three starts: the nearest
half is kept, its mean and covariance measured, distances taken anew, and so on until the
determinant falls no more. The start with the least determinant is reweighted: mean and covariance of all
texts within a chi-square quantile of it. A document is rejected if its Mahalanobis distance
exceeds another. Up to half of a group's distinct texts may be junk.
"""

from __future__ import annotations

from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import ID_KEY, SPACES, TEXT_KEY, pick, row_keys
from scrubspark.session import materialize

SYMBOLS = "#*$%&|<>"
X = ("x1", "x2", "x3", "x4")
MODEL = (*[f"m_{a}" for a in X], *[f"l_{a}{b}" for i, a in enumerate(X) for b in X[: i + 1]])
#: Least standard deviation of each statistic: most groups have no symbols or repeats at all in most texts.
FLOORS = {"x1": 0.04, "x2": 0.1, "x3": 0.03, "x4": 0.03}
#: Unrepeated lines and words added to a text's own, so that a single repeat in a short text is no large share.
FREE_LINES, FREE_WORDS = 10, 100
SHARE = 0.75         # of a group's documents, by distance, that one of the starts rests on
C_STEPS = 3          # of that start
HALF = 0.5           # of a group's distinct texts, by distance, that the estimate rests on
MAX_STEPS = 50       # C-steps at most; they end once the logarithm of no determinant falls by over STILL
STILL = 1e-3
GRID = 50            # slices of a group's values among which its shortest half is looked for
WEIGHTED, WEIGHTED_CUT = 0.975, 11.143  # the chi-square share, and its value, within which texts are weighted in
MIN_GROUP = 100      # distinct texts; smaller groups are pooled by language, then all together
CUTOFF = 23.51       # the chi-square value with four degrees of freedom that one in 10,000 exceeds


def text_statistics(text: Column, df: DataFrame) -> DataFrame:
    """``df`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words`` of ``text`` (null: none)."""
    spaces = r"[\x20\x09-\x0D]+"
    t = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    d = df.select(
        "*",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, spaces)).alias("__w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("__lines"))
    d = d.select("*", F.size("__w").cast("long").alias("n_words"), F.size("__lines").cast("long").alias("n_lines"),
                 (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("__w", lambda x: F.xxhash64(x)).alias("__h")).drop("__w", "__lines")
    # a window of three words by a 64-bit hash, and all windows of a text in order of hash and place
    d = d.withColumn("__t", F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
        lambda i: F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2))))).drop("__h")
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__t")) < F.size("__t"), F.sort_array(
        F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__t")

    def same(k: Column, other: Column) -> Column:
        return F.coalesce(F.get("__s", k)["h"] == F.get("__s", other)["h"], F.lit(False))

    d = d.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.filter(F.transform(
        F.sequence(F.lit(0), F.size("__s") - 1),
        lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get("__s", k)["i"])),
        lambda i: i.isNotNull())))).drop("__s")
    covered = F.aggregate(F.transform("__p", lambda i, k: F.least(F.lit(3), F.coalesce(
        F.get("__p", k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")


def vector(df: DataFrame) -> DataFrame:
    """The transformed statistics ``x1`` to ``x4`` (all defined, also for texts without words)."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.select("*", F.log1p(F.col("word_chars") / n).alias("x1"),
                     F.log1p(10 * F.col("n_symbols") / n).alias("x2"),
                     (F.col("n_dup_lines") / (F.col("n_lines") + FREE_LINES)).alias("x3"),
                     (F.col("n_repeat_words") / (F.col("n_words") + FREE_WORDS)).alias("x4"))


def _consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of a 4-dimensional normal falls short of the whole's."""
    low, high = 0.0, 100.0
    for _ in range(80):  # the chi-square quantile, by bisection of its closed form for 4 degrees of freedom
        q = (low + high) / 2
        low, high = (q, high) if 1 - exp(-q / 2) * (1 + q / 2) < share else (low, q)
    return share / (1 - exp(-q / 2) * (1 + q / 2 + q * q / 8))


def _factor(moments: DataFrame, scale: float, by: tuple[str, ...] = ("key",), plus: bool = False) -> DataFrame:
    """Center ``m_i`` and Cholesky factor ``l_ij`` of each group's covariance, its variances at least (``plus``: plus) the floors'."""
    f = moments
    for i, a in enumerate(X):
        for j, b in enumerate(X[: i + 1]):
            cov = (F.col(f"{a}{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")) * scale
            if a == b:
                cov = F.greatest(cov, F.lit(0.0)) + FLOORS[a] ** 2 if plus else F.greatest(cov, F.lit(FLOORS[a] ** 2))
            rest = reduce(lambda s, k: s - F.col(f"l_{a}{k}") * F.col(f"l_{b}{k}"), X[:j], cov)
            f = f.withColumn(f"l_{a}{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b
                             else rest / F.col(f"l_{b}{b}"))
    return f.select(*by, *MODEL)


def _distance(df: DataFrame) -> DataFrame:
    """``df`` and the squared Mahalanobis distance ``d2`` by the center and factor on the same row."""
    for i, a in enumerate(X):
        rest = reduce(lambda s, k: s - F.col(f"l_{a}{k}") * F.col(f"y_{k}"), X[:i], F.col(a) - F.col(f"m_{a}"))
        df = df.withColumn(f"y_{a}", rest / F.col(f"l_{a}{a}"))
    return df.withColumn("d2", reduce(lambda s, k: s + F.col(f"y_{k}") ** 2, X, F.lit(0.0)))


def _diagonal(scales: DataFrame) -> DataFrame:
    """Center and factor per ``key`` of ``scales (key, m_i, s_i)``, from standard deviations alone."""
    return scales.select("key", *[f"m_{a}" for a in X], *[
        (F.greatest(F.col(f"s_{a}"), F.lit(FLOORS[a])) if a == b else F.lit(0.0)).alias(f"l_{a}{b}")
        for i, a in enumerate(X) for b in X[: i + 1]])


def _medians(points: DataFrame) -> DataFrame:
    """A start per ``key``: medians, and median deviations from them."""
    # a table, so that the join beside it shuffles by its own exchanges, which Spark can split, or not at all
    middle = materialize(points.groupBy("key").agg(
        *[F.percentile_approx(a, 0.5, 1000).alias(f"m_{a}") for a in X]), "mcd-middle")
    off = points.join(middle, "key").groupBy("key").agg(
        *[F.first(f"m_{a}").alias(f"m_{a}") for a in X],
        *[(1.4826 * F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 1000)).alias(f"s_{a}") for a in X])
    return _diagonal(off)


def _shortest_halves(points: DataFrame) -> DataFrame:
    """A start per ``key``: of each statistic the middle of the shortest interval that holds half of the texts."""
    at = [F.lit(i / GRID) for i in range(GRID + 1)]
    q = points.groupBy("key").agg(*[F.percentile_approx(a, F.array(*at), 1000).alias(a) for a in X])

    def shortest(a: str) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(GRID // 2)), lambda i: F.struct(
            (F.get(F.col(a), i + GRID // 2) - F.get(F.col(a), i)).alias("wide"), F.get(F.col(a), i).alias("low"))))

    q = q.select("key", *[shortest(a).alias(a) for a in X])
    return _diagonal(q.select("key", *[(F.col(f"{a}.low") + F.col(f"{a}.wide") / 2).alias(f"m_{a}") for a in X],
                              *[(F.col(f"{a}.wide") / 1.349).alias(f"s_{a}") for a in X]))


def _moments(near: DataFrame, *by: str) -> DataFrame:
    return near.groupBy(*by).agg(
        *[F.avg(a).alias(f"m_{a}") for a in X],
        *[F.avg(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(X) for b in X[: i + 1]])


def fit(points: DataFrame) -> DataFrame:
    """A start per ``key`` of ``points (key, x1..x4)``: C_STEPS C-steps by SHARE from the medians."""
    model = materialize(_medians(points), "mcd")
    for _ in range(C_STEPS):
        near = _distance(points.join(model, "key")).select("key", *X, "d2")
        cut = materialize(near.groupBy("key").agg(F.percentile_approx("d2", SHARE, 1000).alias("cut")), "mcd-cut")
        kept = near.join(cut, "key").where("d2 <= cut")
        model = materialize(_factor(_moments(kept, "key"), _consistency(SHARE), plus=True), "mcd")
    return model


def _volume(model: DataFrame) -> Column:
    """The logarithm of the covariance's determinant."""
    return 2 * reduce(lambda s, k: s + F.log(f"l_{k}{k}"), X, F.lit(0.0))


def robust_fit(points: DataFrame) -> DataFrame:
    """Center and factor per ``key`` of ``points (key, x1..x4)``: the reweighted minimum covariance determinant."""
    by = ("key", "start")
    starts = [_medians(points), _shortest_halves(points), fit(points)]
    model = materialize(reduce(DataFrame.unionByName, [
        m.withColumn("start", F.lit(i)).withColumn("volume", F.lit(float("inf"))) for i, m in enumerate(starts)]), "mcd-starts")
    done = None
    for step in range(MAX_STEPS):
        near = _distance(points.join(model.select(*by, *MODEL), "key")).select(*by, *X, "d2")
        cut = materialize(near.groupBy(*by).agg(F.percentile_approx("d2", HALF, 1000).alias("cut")), "mcd-cut")
        kept = near.join(cut, [*by]).where("d2 <= cut")
        after = _factor(_moments(kept, *by), _consistency(HALF), by)
        after = after.withColumn("volume", _volume(after)).join(
            model.select(*by, F.col("volume").alias("last")), [*by])
        after = materialize(after.withColumn("still", F.col("volume") >= F.col("last") - STILL), "mcd-step")
        still = after.where("still") if step < MAX_STEPS - 1 else after
        done = still if done is None else done.unionByName(still)
        model = after.where("not still").select(*by, *MODEL, "volume")
        if model.isEmpty():
            break
    best = materialize(done.groupBy("key").agg(F.min_by(F.struct(*MODEL), F.struct("volume", "start")).alias("m"))
                       .select("key", "m.*"), "mcd-best")
    near = _distance(points.join(best, "key")).where(F.col("d2") <= WEIGHTED_CUT).select("key", *X)
    return materialize(_factor(_moments(near, "key"), _consistency(WEIGHTED)), "mcd")


def quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, cutoff: float = CUTOFF,
            id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance2``, and its row key.

    ``base_failed``: too few words, or too many of them repeated. Groups are language and source
    (null: a value of its own); groups under MIN_GROUP documents are pooled by language, and
    languages whose pool is smaller all together. The estimates rest on the distinct texts of documents
    that don't fail the base rules; ``kept`` is false for those that fail them and for outliers.
    A null text has no words.
    """
    d = pick(docs, id_col, text_col, lang_col, source_col).toDF("doc_id", "text", "lang", "source")
    none = F.lit("(none)")
    d = d.select("doc_id", "text", *row_keys(F.col("doc_id"), F.col("text")), F.coalesce("lang", none).alias("lang"),
                 F.coalesce("source", none).alias("source"))
    s = text_statistics(F.col("text"), d).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    s = materialize(vector(s).withColumn("base_failed", failed), "quality")
    sound = s.where("not base_failed")
    # copies of a text count once, however many there are
    texts = materialize(sound.groupBy("lang", "source", TEXT_KEY).agg(*[F.first(a).alias(a) for a in X]), "quality-texts")
    n = texts.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = n.where(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("pool"))
    groups = materialize(n.join(small, "lang", "left").select(
        "lang", "source", F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\x1f", "lang", "source"))
        .when(F.col("pool") >= MIN_GROUP, F.col("lang")).otherwise("").alias("key")), "quality-groups")
    points = materialize(texts.join(groups, ["lang", "source"]).select("key", *X), "quality-points")
    model = robust_fit(points)
    judged = _distance(s.join(groups, ["lang", "source"], "left").join(model, "key", "left"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).alias("kept"),
        F.col("d2").alias("distance2"), ID_KEY, TEXT_KEY)
