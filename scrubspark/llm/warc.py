"""WARC archives and their index: write, read back, merge the runs.

Pages become WARC records in gzip text files of the shared folder (each file of bounded record
count, written by Spark's own writer, so that lost tasks leave nothing half-written). Reading an
archive gives its captures as a run, sorted by URL key and time; runs lie in a table. The index is
merged range by range: each range gets its stretch of every run and merges them with a loser tree.
Ranges are cut by URL key, time and page, so that a URL with very many captures spans ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubspark.llm.common import pick
from scrubspark.session import materialize, scratch_path

RECORDS_PER_FILE = 4096
ENTRIES_PER_RANGE = 100_000
EPOCH = "2024-01-01 00:00:00"   # of captures without a time of their own; the page id counts seconds
DAY = 86_400
LAST = 2_900_000 * DAY          # larger ids (and those under minus a quarter of it) share the last day
ENTRY = ("page_id long, url string, url_key string, captured string, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long, archive string, record_offset long, record_bytes long")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, from its hexadecimal digits: five of them are four base32 digits."""
    h = F.sha1(data)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 5 * j + 1, 5), 16, 32), 4, "0") for j in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str) -> str:
    """Sortable form of a URL: host labels reversed (without ``www.``), then ``)`` and what follows, lowered, no fragment."""
    m = re.fullmatch(r"(?s)(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)(?:#.*)?", url)
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + m[2].lower()


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``record``: the text of one WARC record per row of ``pages``, without its last line end.

    Null pages are empty, null URLs too. Of pages with equal payloads of at least ``min_bytes``
    bytes the one with the largest id is a response, others revisit it (rows that repeat that id
    and payload are responses as well; ids that are null revisit unless all are).
    """
    p = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    p = p.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
                 F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    p = p.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    copies = (p.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1"))
    copies = materialize(copies.select("payload_digest", "response"), "warc-copies")
    p = p.join(copies, "payload_digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    p = p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    seconds = F.greatest(F.least(F.coalesce("page_id", F.lit(0)).cast("long"), F.lit(LAST)), F.lit(-LAST // 4))
    day, second = F.floor(seconds / DAY).cast("int"), F.pmod(seconds, F.lit(DAY)).cast("int")
    date = F.concat(F.date_add(F.lit(EPOCH).cast("date"), day).cast("string"), F.lit("T"), F.date_format(
        F.timestamp_add("SECOND", second, F.lit(EPOCH).cast("timestamp_ntz")), "HH:mm:ss'Z'"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")), line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("response")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Page-ID", F.col("page_id")), line("X-Refers-To-Page", F.when(revisit, F.col("response"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(payload)).cast("string"), F.lit("\r\n\r\n"))
    return p.select(F.concat(head, http, payload, F.lit("\r\n\r")).alias("record"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Write ``pages`` as WARC archives (one gzip stream per file) into the folder ``path``."""
    (records(pages, **columns).write.option("compression", "gzip").option("lineSep", "\n")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_archive(content: bytes, archive: str) -> Iterator[tuple]:
    """The entries of one archive, in its order; a payload that doesn't match its digest raises."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as raw, io.BufferedReader(raw, 1 << 20) as f:
        at = 0
        while version := f.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no record at {at} of {archive}")
            size, head = len(version), {}
            while (row := f.readline()) not in (b"\r\n", b""):
                size += len(row)
                name, _, value = row.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
                head[name] = value
            n = int(head["Content-Length"])
            block, tail = f.read(n), f.read(4)
            if len(block) != n or tail != b"\r\n\r\n":
                raise ValueError(f"a record ends early at {at} of {archive}")
            size += 2 + n + 4
            payload = block.partition(b"\r\n\r\n")[2]
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if head["WARC-Type"] == "response":
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload at {at} of {archive} doesn't match its digest")
                length = len(payload)
            else:
                length = int(head["X-Payload-Length"])
            page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
            url = head.get("WARC-Target-URI", "")
            yield (None if page is None else int(page), url, url_key(url), head["WARC-Date"], length, digest,
                   head["WARC-Type"], None if refers is None else int(refers), archive, at, size)
            at += size


def _order(e: tuple) -> tuple:
    """URL key, time, page (null first)."""
    return e[2], e[3], e[0] is not None, e[0] or 0


COLUMNS = [c.split()[0] for c in ENTRY.split(",")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    return out.assign(**{c: pd.array(list(out[c]), dtype="Int64") for c in ("page_id", "refers_to")})


def runs(spark, path: str) -> DataFrame:
    """The captures of the archives in ``path``, as a table of one sorted run per archive."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield _frame(sorted(parse_archive(content, name.rsplit("/", 1)[-1]), key=_order))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return materialize(files.mapInPandas(read, ENTRY), "warc-runs")


def merge(sorted_runs: list[list[tuple]]) -> Iterator[tuple]:
    """K-way merge of sorted runs by a loser tree: each step replays one path from a leaf to the root."""
    k = len(sorted_runs)
    if not k:
        return
    heads, last = [0] * k, (1,)
    keys = [(0, *_order(r[0])) if r else last for r in sorted_runs]
    losers = [-1] * k   # inner node n has children 2n and 2n+1; leaf i is node k+i; losers[0] is the winner

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, lose = (a, b) if (keys[a], a) <= (keys[b], b) else (b, a)
        losers[node] = lose
        return win

    winner = play(1) if k > 1 else 0
    while keys[winner] is not last:
        run = sorted_runs[winner]
        yield run[heads[winner]]
        heads[winner] += 1
        keys[winner] = (0, *_order(run[heads[winner]])) if heads[winner] < len(run) else last
        node = (k + winner) // 2
        while node:
            other = losers[node]
            if (keys[other], other) < (keys[winner], winner):
                losers[node], winner = winner, other
            node //= 2


def histories(run_table: DataFrame, entries_per_range: int = ENTRIES_PER_RANGE) -> DataFrame:
    """The merged index: all entries and ``history_pos``, their place by URL key, time and page (from 0)."""
    n = run_table.count()
    ranges = max(1, ceil(n / entries_per_range))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretches: dict[str, list[list[tuple]]] = {}
        for pdf in batches:
            ids = {c: pdf[c].where(pdf[c].notna(), None) for c in ("page_id", "refers_to")}
            pdf = pdf.astype(object).assign(**{c: [None if x is None else int(x) for x in v] for c, v in ids.items()})
            for e in pdf.itertuples(index=False, name=None):
                mine = stretches.setdefault(e[8], [[]])
                if mine[-1] and _order(mine[-1][-1]) > _order(e):
                    mine.append([])  # blocks of a run may arrive out of order; each is sorted
                mine[-1].append(e)
        part, rows, pos = TaskContext.get().partitionId(), [], 0
        for e in merge([s for m in stretches.values() for s in m]):
            rows.append(e)
            if len(rows) == 10_000:
                yield _frame(rows).assign(part=part, pos=range(pos, pos + len(rows)))
                pos, rows = pos + len(rows), []
        if rows:
            yield _frame(rows).assign(part=part, pos=range(pos, pos + len(rows)))

    dealt = run_table.withColumn("page_id", F.col("page_id").cast("string")).withColumn(
        "refers_to", F.col("refers_to").cast("string"))  # nullable numbers would turn float in pandas
    dealt = dealt.repartitionByRange(ranges, F.col("url_key"), F.col("captured"), F.col("page_id").cast("long"))
    out = materialize(dealt.mapInPandas(merged, ENTRY + ", part int, pos long"), "warc-index")
    sizes = out.groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    return out.join(starts, "part").withColumn("history_pos", F.col("start") + F.col("pos")).drop("part", "pos", "start")


def capture_histories(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and merge their index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **columns)
    return histories(runs(spark, path))
