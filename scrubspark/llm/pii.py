"""Personal data: patterns, and terms that give them away, in DataFrame operations only.

Patterns find entities (e-mail and IP addresses, card and phone numbers). All words of a document that
holds an entity (outside of e-mail addresses) co-occur with it. Over the corpus, a term t reveals an
entity e by as much as PMI(e; t) / IC(e) = log(n_et N / (n_e n_t)) / log(N / n_e), where the n count
documents: 1 if t is found nowhere but with e, 0 if they meet by chance. A term that reveals some entity
by the lower threshold or more is generalised, by the upper one removed, wherever it stands: in every
document, with the entity or without it.

Pairs are not made where they can't tell: an entity or term in fewer than ``MIN_SUPPORT`` documents has no
support, entities found in the same documents count as one (their terms reveal each alike), and a
threshold r needs n_t <= N^(1-r) n_e^r, as n_et <= n_e. Against chance the co-occurrences must weigh
``EVIDENCE`` in all (n_et log(N / n_e)): rare words fall among the documents of a very common entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import ID_KEY, TEXT_KEY, pick, row_keys
from scrubspark.plans.bitmap import in_bitmap
from scrubspark.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the query contract, written so that no run of characters is scanned twice: a match
#: starts at the start of its run or at the end of the last match, and repeats give nothing back.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
MIN_SUPPORT = 2      # documents in which a term must stand with the entity
EVIDENCE = 7.0       # and the natural logarithm of the odds against all of them by chance: 1 in 1,100
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
SMALL = 100_000      # rows of a table that is broadcast, at most
HOT = 1_000          # entities in over 1 / HOT of all mentions are joined by broadcast: so many at most
BLOCK = 64           # matches placed together
SPAN = "array<struct<start:int,end:int,value:string>>"
MARK = "array<struct<start:int,end:int,action:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _unzeroed(part: Column) -> Column:
    return F.regexp_replace(part, "^0+", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(_unzeroed(p)) <= 3) & (
            F.coalesce(F.substring(_unzeroed(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _placed(matches: str, gaps: str) -> Column:
    """Spans of matches, from the matches and the texts between them (two array columns)."""
    n, nothing = F.size(matches), F.array().cast(SPAN)

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(matches, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), F.get(matches, i).alias("value")))).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        # an array is copied at each match: within a block only, and once a block
        inner = F.aggregate(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, n) - 1),
                            F.struct(acc["at"].alias("at"), nothing.alias("out")), add)
        return F.transform(F.array(inner), lambda x: F.struct(
            x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))[0]

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    return F.when(n > 0, F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nothing.alias("out")), block,
                                     lambda acc: acc["out"])).otherwise(nothing)


def _of(fn, kind: str):
    """``fn(kind, value of a span)`` as a function of the span alone (Spark counts a lambda's parameters)."""
    return lambda s: fn(kind, s["value"])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and, per kind, the column of its spans (code points, end exclusive) in ``text`` (never null)."""
    d = docs
    for k in KINDS:
        d = d.withColumn(f"__m_{k}", F.when(F.col(text).rlike(GUARDS[k]), F.regexp_extract_all(
            text, F.lit(PATTERNS[k]), 0)).otherwise(F.array().cast("array<string>")))
    for k in KINDS:
        d = d.withColumn(f"__g_{k}", F.when(F.size(f"__m_{k}") > 0, F.split(text, PATTERNS[k], -1)))
    for k in KINDS:
        d = d.withColumn(k, _placed(f"__m_{k}", f"__g_{k}"))
    for k in KINDS:
        d = d.withColumn(k, F.filter(k, _of(_valid, k)))
    return d.drop(*[f"__m_{k}" for k in KINDS], *[f"__g_{k}" for k in KINDS])


def _named(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value))


def _blanked(text: Column) -> Column:
    """The text with spaces for its e-mail addresses, the only entities with letters: its words are terms."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), 0)
    pieces = F.zip_with(F.split(text, PATTERNS["email"], -1), matches,
                        lambda gap, m: F.concat(gap, F.repeat(F.lit(" "), F.coalesce(F.length(m), F.lit(0)))))
    return F.when(text.contains("@"), F.array_join(pieces, "")).otherwise(text)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_blanked(text)), F.lit(TERM), 0))


def _among(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose term may be one of ``wanted`` (column ``term``): by a bitmap of bounded size."""
    n = wanted.count()
    if not n:
        return df.where("false")
    return df.where(in_bitmap(F.xxhash64(column), wanted.select(F.xxhash64("term")), n))


def _sized(df: DataFrame) -> DataFrame:
    """``df`` (written before), to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def term_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``term, n_t``: in how many rows of ``texts (text)`` each of ``wanted (term)`` stands.

    Words first pass a bitmap of the wanted terms' hashes; counts are pre-aggregated by task, an exact join follows.
    """
    words = _among(texts.select(F.explode(_words(F.col("text"))).alias("term")), "term", wanted)
    return words.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted.distinct(), "term", "left_semi")


def _classes(mentions: DataFrame, n_docs: int, min_support: int) -> DataFrame:
    """``entity, n_e`` and row key: one entity of those found in the same documents, in each of them.

    ``mentions``: distinct (entity, row key). An entity in very many documents isn't sent to one task.
    """
    keys = [ID_KEY, TEXT_KEY]
    entities = materialize(mentions.groupBy("entity").agg(
        F.count("*").alias("n_e"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).alias("where")).where(
        (F.col("n_e") >= min_support) & (F.col("n_e") < n_docs)), "pii-entities")
    one = materialize(entities.groupBy("n_e", "where").agg(F.min("entity").alias("entity")).drop("where"), "pii-classes")
    hot = F.col("n_e") * HOT >= mentions.count()
    hot_names, hot_ones = entities.where(hot).select("entity"), one.where(hot)
    rest = mentions.join(F.broadcast(hot_names), "entity", "left_anti").join(one.where(~hot), "entity")
    return mentions.join(F.broadcast(hot_ones), "entity").unionByName(rest)


def disclosures(mentions: DataFrame, docs: DataFrame, least: float, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``term, reveals``: by how much each term gives away the entity it reveals most, if that is ``least`` or more.

    ``mentions``: distinct entity and row key; ``docs``: all documents, with ``text`` and row key.
    """
    keys = [ID_KEY, TEXT_KEY]
    n = docs.count()
    classes = materialize(_classes(mentions, n, min_support), "pii-classes-by-document")
    held = docs.join(classes.select(*keys).distinct(), keys, "left_semi")
    words = materialize(held.select(*keys, F.explode(_words(F.col("text"))).alias("term")).distinct(), "pii-words")
    supported = materialize(words.groupBy("term").count().where(F.col("count") >= min_support).select("term"), "pii-terms")
    most = classes.agg(F.max("n_e")).first()[0] or 0

    def bound(n_e: Column) -> Column:      # terms in more documents can't reach ``least``
        return F.pow(F.lit(float(max(n, 1))), F.lit(1 - least)) * F.pow(n_e.cast("double"), F.lit(least)) * (1 + 1e-9)

    n_t = materialize(term_counts(docs, supported).where(F.col("n_t") <= bound(F.lit(most))), "pii-term-counts")
    rare = _among(words, "term", n_t).join(_sized(n_t), "term")
    n_et = (rare.join(classes, keys).where(F.col("n_t") <= bound(F.col("n_e")))
            .groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.min("n_e").alias("n_e"), F.min("n_t").alias("n_t")))
    pmi = F.log(F.col("n_et") * F.lit(n) / (F.col("n_e") * F.greatest("n_t", "n_et")))
    ic = F.log(F.lit(n) / F.col("n_e"))
    told = n_et.where((F.col("n_et") >= min_support) & (F.col("n_et") * ic >= EVIDENCE))
    return told.groupBy("term").agg(F.max(pmi / ic).alias("reveals")).where(F.col("reveals") >= least)


def _marked(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Row key and ``terms (start, end, action)``: every place at which a flagged term stands, in all of ``docs``."""
    n = flagged.count()
    if not n:
        return docs.where("false").select(ID_KEY, TEXT_KEY, F.array().cast(MARK).alias("terms"))
    # first the documents that hold one, by their distinct words; words are placed in those alone
    words = docs.select(ID_KEY, TEXT_KEY, F.explode(_words(F.col("text"))).alias("term"))
    some = _among(words, "term", flagged).join(_sized(flagged), "term", "left_semi")
    some = docs.join(some.select(ID_KEY, TEXT_KEY).distinct(), [ID_KEY, TEXT_KEY], "left_semi").dropDuplicates(
        [ID_KEY, TEXT_KEY])
    b = some.withColumn("b", _blanked(F.col("text")))
    b = b.withColumn("__m", F.regexp_extract_all("b", F.lit(TERM), 0)).withColumn("__g", F.split("b", TERM, -1))
    placed = b.select(ID_KEY, TEXT_KEY, F.explode(_placed("__m", "__g")).alias("w")).select(
        ID_KEY, TEXT_KEY, F.lower("w.value").alias("term"), "w.start", "w.end")
    spans = _among(placed, "term", flagged).join(_sized(flagged), "term")
    return spans.groupBy(ID_KEY, TEXT_KEY).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))


def analyse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = GENERALISE_AT,
            remove_at: float = REMOVE_AT, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``doc_id``, the span columns of the four kinds, and ``terms (start, end, action)``, per row of ``docs``.

    ``action`` is ``remove`` or ``generalise``. A null text counts as empty. Rows that repeat id and
    text count once as holders of an entity and get the same spans.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row_keys(F.col("doc_id"), F.col("text")))
    any_ = F.col("text").rlike("|".join(GUARDS.values()))
    found = materialize(find(d.withColumn("text", F.when(any_, F.col("text")).otherwise(""))).select(
        "doc_id", ID_KEY, TEXT_KEY, *KINDS), "pii-found")

    def named(kind: str):
        return lambda s: _named(kind, s["value"])

    names = F.flatten(F.array(*[F.transform(k, named(k)) for k in KINDS]))
    mentions = materialize(found.select(ID_KEY, TEXT_KEY, F.explode(F.array_distinct(names)).alias("entity")).distinct(),
                           "pii-mentions")
    told = disclosures(mentions, d, generalise_at, min_support)
    flagged = materialize(told.select("term", F.when(F.col("reveals") >= remove_at, "remove").otherwise(
        "generalise").alias("action")), "pii-flagged")
    marks = materialize(_marked(d, flagged), "pii-terms-placed")
    return found.join(marks, [ID_KEY, TEXT_KEY], "left").withColumn("terms", F.coalesce("terms", F.array().cast(MARK)))


def span_text(kinds: tuple[str, ...] = KINDS, terms: bool = False) -> Column:
    """``kind:start:end`` of the span columns, comma-joined, by kind, then place."""
    def spelled(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))

    parts = [F.transform(k, spelled(k)) for k in kinds]
    if terms:
        parts.append(F.transform("terms", spelled("term")))
    return F.array_join(F.flatten(F.array(*parts)), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analysed: DataFrame | None = None,
             **thresholds: float) -> DataFrame:
    """``doc_id, text`` and row key: entities replaced by their kind in brackets, terms by ``[TERM]`` or nothing.

    Of spans that overlap, the one that starts first is replaced, and the later ones as far as they go on. A null
    text stays null. ``analysed``: what ``analyse`` gave for these rows, if it is there already.
    """
    a = analyse(docs, id_col, text_col, **thresholds) if analysed is None else analysed

    def marked(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("by"))

    marks = F.array_sort(F.flatten(F.array(
        *[F.transform(k, marked(k)) for k in KINDS],
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(
            s["action"] == "remove", "").otherwise("[TERM]").alias("by"))))))
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").select(
        "doc_id", "text", *row_keys(F.col("doc_id"), F.col("text")))
    m = a.select(ID_KEY, TEXT_KEY, marks.alias("marks")).where(F.size("marks") > 0).dropDuplicates([ID_KEY, TEXT_KEY])

    def add(acc: Column, s: Column) -> Column:
        gap = F.greatest(s["start"] - acc["at"], F.lit(0))
        kept = F.substring(acc["piece"], acc["at"] - acc["base"] + 1, gap)
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"), F.concat(acc["out"], kept, s["by"]).alias("out"), acc["piece"].alias("piece"),
            acc["base"].alias("base")))

    def block(acc: Column, b: Column) -> Column:
        # a place in a text is found by walking to it: once a block, then within the block's piece alone
        some = F.slice("marks", b * BLOCK + 1, F.lit(BLOCK))
        reach = F.greatest(F.element_at(some, -1)["start"] - acc["at"], F.lit(0))
        first = F.struct(acc["at"].alias("at"), F.lit("").alias("out"),
                         F.substring(F.col("text"), acc["at"] + 1, reach).alias("piece"), acc["at"].alias("base"))
        return F.transform(F.array(F.aggregate(some, first, add)), lambda x: F.struct(
            x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size("marks") - 1) / BLOCK).cast("int"))
    done = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), block, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return d.join(m, [ID_KEY, TEXT_KEY], "left").select(
        "doc_id", F.when(F.col("marks").isNull(), F.col("text")).otherwise(done).alias("text"), ID_KEY, TEXT_KEY)
