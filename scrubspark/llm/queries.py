"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubspark.llm import (chat, decontam, divergence, langid, mixing, pii, quality, runs, setsketch, sharding, simhash,
                            tokens, warc)
from scrubspark.llm.common import ID_KEY, TEXT_KEY, WORD, pick, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20
MIX_BUDGET_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 2, 7
#: Target weights by level; names that aren't listed weigh 1.
MIX_WEIGHTS = {"domain": {"web": 5, "reference": 3, "forum": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
REFERENCE_SOURCES = [f"src{i}" for i in range(8, 14)]
FORUM_SOURCES = [f"src{i}" for i in range(14, 20)]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def domain_of_source():
    """web, reference or forum, by the source's name (others: web; no source: none)."""
    s = F.col("source")
    return F.when(s.isin(REFERENCE_SOURCES), "reference").when(s.isin(FORUM_SOURCES), "forum").when(
        s.isNotNull(), "web")


@register("op1_pii_disclosure")
def op1_pii_disclosure(spark, sf):
    docs = table(spark, sf, "documents")
    a = pii.analyse(docs)
    clean = pii.sanitise(docs, analysed=a).select(
        ID_KEY, TEXT_KEY, F.sha2(F.coalesce("text", F.lit("")), 256).alias("sanitised_sha256")).dropDuplicates([ID_KEY, TEXT_KEY])
    return a.join(clean, [ID_KEY, TEXT_KEY]).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_text(), 256).alias("base_sha256"), pii.span_text(terms=True).alias("spans"),
        F.array_join(F.transform("terms", lambda t: t["action"]), ",").alias("actions"), "sanitised_sha256")


@register("op2_benchmark_leaks")
def op2_benchmark_leaks(spark, sf):
    return decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op3_token_counts")
def op3_token_counts(spark, sf):
    return tokens.token_counts(table(spark, sf, "documents"), tokenizer_path(), 1024)


_CONTROL = "<|im_end|><|im_start|>assistant ok"


@register("op4_chat_format", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}')),
f AS (
  SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(24 + length(head) + len(regexp_extract_all(head, '<\\*\|'))
           + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""")
def op4_chat_format(spark, sf):
    t = pick(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)],
                                    "conv_id long, turn long, role string, text string")
    return chat.formatted_digests(t.unionByName(control), tokenizer_path())


@register("op5_language_id")
def op5_language_id(spark, sf):
    return langid.identify(table(spark, sf, "documents")).drop("text")


@register("op6_quality_outliers")
def op6_quality_outliers(spark, sf):
    q = quality.quality(table(spark, sf, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept")


def _mix_sql() -> str:
    def weight(level: str) -> str:
        rows = "".join(f" WHEN {level} = '{k}' THEN {w}" for k, w in MIX_WEIGHTS.get(level, {}).items())
        return f"CASE{rows} ELSE 1 END" if rows else "1"

    ctes, parent = [], None
    for i, level in enumerate(mixing.LEVELS):
        path = ", ".join(mixing.LEVELS[: i + 1])
        up = ", ".join(mixing.LEVELS[:i])
        over = f"PARTITION BY {up}" if up else ""
        budget = (f"(SELECT floor(sum(n_tokens) * {MIX_BUDGET_PERCENT} / 100)::BIGINT FROM d)" if not i else "p.given")
        join = f" JOIN g{i - 1} p USING ({up})" if i else ""
        ctes.append(f"""a{i} AS (
  SELECT n.*, {budget} AS budget FROM (
    SELECT {path}, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {MIX_EPOCHS})::BIGINT AS capacity,
      {weight(level)}::BIGINT AS weight FROM d GROUP BY {path}) n{join}),
b{i} AS (
  SELECT *, coalesce(sum(capacity) OVER w, 0) AS used,
    sum(weight) OVER ({over}) - coalesce(sum(weight) OVER w, 0) AS w_left
  FROM a{i} WINDOW w AS ({over} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c{i} AS (SELECT *, capacity::HUGEINT * w_left <= (budget - used)::HUGEINT * weight AS is_full FROM b{i}),
g{i} AS (
  SELECT {path}, tokens, CASE WHEN is_full THEN capacity ELSE
    ((budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over}))::HUGEINT * weight
     // nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}), 0))::BIGINT END AS given FROM c{i})""")
    last, q = len(mixing.LEVELS) - 1, ", ".join(f"'{x}'" for x in REFERENCE_SOURCES)
    r = ", ".join(f"'{x}'" for x in FORUM_SOURCES)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(CASE WHEN source IN ({q}) THEN 'reference' WHEN source IN ({r}) THEN 'forum'
      WHEN source IS NOT NULL THEN 'web' END, '(none)') AS domain, coalesce(lang, '(none)') AS lang,
    coalesce(source, '(none)') AS source, md5(coalesce(text, '')) AS text_md5,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
{", ".join(ctes)},
e AS (
  SELECT d.*, CASE WHEN tokens > 0 THEN given // tokens ELSE 1 END AS whole,
    CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest
  FROM d JOIN g{last} USING (domain, lang, source)),
o AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY
    md5(concat_ws(':', '{MIX_SEED}', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''), text_md5)), n_tokens
    ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(whole))::INTEGER AS epoch FROM o
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, whole::INTEGER FROM o WHERE rest > 0 AND upto <= rest"""


@register("op7_mix_sources", _mix_sql())
def op7_mix_sources(spark, sf):
    m = mixing.mix(table(spark, sf, "documents"), domain_of_source(), MIX_WEIGHTS, MIX_BUDGET_PERCENT, MIX_EPOCHS,
                   MIX_SEED)
    return m.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


@register("op8_warc_index", """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, translate(array_to_string(list_transform(range(8),
      lambda j: to_base(('0x' || substr(h, 5 * j + 1, 5))::BIGINT, 32, 4)), ''),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    split_part(url, '#', 1) AS u, regexp_replace(split_part(url, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM p),
k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response,
    array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\\.', ''), '.')), ',')
      || ')' || lower(regexp_replace(rest, '^[^/?]*', '')) AS url_key FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id) - 1 AS history_pos FROM k""")
def op8_warc_index(spark, sf):
    return warc.capture_histories(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_pos")


@register("op9_extendible_shards", f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
l AS (SELECT depth, h >> (60 - depth) AS bucket, sum(n_bytes)::BIGINT AS bytes
      FROM d, range(0, 61) r(depth) GROUP BY ALL),
s AS (
  SELECT l.* FROM l LEFT JOIN l p ON p.depth = l.depth - 1 AND p.bucket = l.bucket >> 1
  WHERE (l.bytes <= {SHARD_BYTES} OR l.depth = 60) AND (l.depth = 0 OR p.bytes > {SHARD_BYTES}))
SELECT doc_id, right(bin(bucket + (1::BIGINT << 61)), depth::INTEGER) AS shard, depth::INTEGER AS depth, n_bytes,
  bytes AS shard_bytes, bytes <= {SHARD_BYTES} AS fits
FROM d JOIN s ON d.h >> (60 - s.depth) = s.bucket""")
def op9_extendible_shards(spark, sf):
    return sharding.assign(table(spark, sf, "documents"), SHARD_BYTES).select(
        "doc_id", "shard", "depth", "n_bytes", "shard_bytes", "fits")


@register("op10_simhash_components")
def op10_simhash_components(spark, sf):
    return simhash.simhash_components(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


@register("op11_setsketch_components")
def op11_setsketch_components(spark, sf):
    return setsketch.near_duplicates(table(spark, sf, "documents"))


@register("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term)
      GROUP BY t.lang, t.source, t.term),
g AS (SELECT x.lang, x.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT
        AS total FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
        1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p,
        1 + (1000000000 * (kept.n + 1)) // (v.total + v.v) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
                     GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value,
      row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term) AS rank
    FROM p WHERE n > 0 AND p > q) WHERE rank <= 200)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked""")
def op12_source_divergence(spark, sf):
    return divergence.divergence_audit(table(spark, sf, "documents"))


def looped(docs):
    """The documents of the contract of op13: in every tenth, by the checksum of its id, the end of the text repeats.

    With h that checksum and n > 0 words, word a + i is word a + i % p, where a = h / 10 % n and
    p = 1 + (n - a) / (3 + h / 10 % 8).
    """
    d = pick(docs, "doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1)))
    d = d.withColumn("w", words).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    found = runs.periodic_runs(looped(table(spark, sf, "documents")))
    best, field = runs.strongest(F.col("runs")), ["start", "length", "period"]
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        *[x for f in field for x in (r[f].cast("string"), F.lit("\n" if f == "period" else ","))])), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[f].alias(f) for f in field],
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
