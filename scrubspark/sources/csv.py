"""CSV in and out.

Reading is two-step, as a Spark user would do it without ``inferSchema``: read every
column as text, turn null tokens into NULL, then infer each column's type with one
aggregate pass that counts, per column, the values each candidate type accepts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.contracts import qcol
from scrubspark.functions.parse import INFINITY_WORDS, NUMBER_PATTERN, to_number

# pandas' default missing-value tokens for read_csv.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Text read as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
INT_PATTERN = r"^\s*[+-]?\d+\s*$"


ORDER_COLUMNS = ["_file", "_block", "_row"]
_BEYOND = "__beyond_header"

# A quoted cell from its opening quote on, with doubled quotes inside; complete cells; and a line that, from
# outside a quoted cell, ends inside one, or from inside one leaves it (possessive: no way back).
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_OPEN = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+"{_QUOTED}'
_ENDS_INSIDE = re.compile(_OPEN, re.S)
_CLOSES = re.compile(rf'{_QUOTED}"[^,]*+', re.S)


def _ends_inside(line: str, start: int = 0) -> bool:
    """Whether a line (from ``start``, the start of a cell) ends inside a quoted cell."""
    return '"' in line and _ENDS_INSIDE.fullmatch(line, start) is not None


def _stays_inside(line: str) -> bool:
    """The same for a line that starts inside one: it isn't closed, or another one is opened after it."""
    m = _CLOSES.match(line) if '"' in line else None
    return m is None or (m.end() < len(line) and _ends_inside(line, m.end() + 1))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list[str]]]:
    """The lines of each split in turn: file, start of the split, whether its lines go on from the last item, lines."""
    last = None
    for batch in batches:
        files, blocks = batch.column("_file").to_pylist(), batch.column("_block").to_pylist()
        lines, start = batch.column("value").to_pylist(), 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or blocks[i] != blocks[start] or files[i] != files[start]:
                key = files[start], blocks[start]
                yield *key, key == last, lines[start:i]
                last, start = key, i


def _state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split under both quote states: whether it ends inside a quoted cell if it starts outside one, and if
    inside, and whether then some line of it ends outside (so that the record that came in ends here)."""
    def row(s: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("_file", "_block", "out", "ins", "ended"), s)})

    held = None
    for file, block, goes_on, lines in _splits(batches):
        if not goes_on:
            if held:
                yield row(held)
            held = [file, block, False, True, False]
        for line in lines:
            if '"' in line:
                held[2] = _stays_inside(line) if held[2] else _ends_inside(line)
                held[3] = _stays_inside(line) if held[3] else _ends_inside(line)
                held[4] = held[4] or not held[3]
    if held:
        yield row(held)


def _compose(maps: Iterable[tuple]) -> list[tuple[str, int, int]]:
    """(file, split, split in which its first record starts) for the splits of a file that start inside a cell."""
    inside, opener, found = False, 0, []
    for file, block, out, ins, ended in maps:
        if inside:
            found.append((file, block, opener))
            if ended:     # the record that came in ends here
                opener = block
            inside = ins
        else:
            inside, opener = out, block
    return found


def _starts_inside(lines: DataFrame) -> dict[tuple[str, int], int]:
    """For each split that starts inside a quoted cell: the split in which that record starts.

    The maps of a file's splits are composed in order, one small row a split, files apart.
    """
    maps = lines.mapInArrow(_state_maps, "_file string, _block bigint, out boolean, ins boolean, ended boolean")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _compose(pdf.sort_values("_block").itertuples(index=False))
        return pd.DataFrame(found, columns=["_file", "_block", "opener"]).astype({"_file": object, "_block": "int64",
                                                                                  "opener": "int64"})

    rows = maps.groupBy("_file").applyInPandas(compose, "_file string, _block bigint, opener bigint").collect()
    return {(r[0], r[1]): r[2] for r in rows}


def _records(lines: DataFrame, inside: dict[tuple[str, int], int], pieces: bool) -> DataFrame:
    """``_file, _block, _row, part, record``: the records that lie within a split, by their first line's number; or
    (``pieces``) the pieces of those that don't, by the split in which the record starts."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("_file", "_block", "_row", "part", "record")
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        out: list[tuple] = []
        held, key, opener, start, no, quoted = [], None, 0, 0, 0, False
        files = {file for file, _ in inside}

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out.clear()

        def end() -> None:      # the record goes on in the next split, or the file ends within quotes
            if held and pieces:
                out.append((key[0], opener, start, key[1], "\n".join(held)))

        for file, block, goes_on, some in _splits(batches):
            if not goes_on:
                end()
                held, key, no = [], (file, block), 0
                quoted = key in inside
                opener, start = inside.get(key, block), -1 if quoted else 0
            if pieces and file not in files:
                continue
            for line in some:
                if not held and not quoted:
                    opener, start = block, no
                held.append(line)
                quoted = _stays_inside(line) if quoted else _ends_inside(line)
                if not quoted:
                    if (opener != block) == pieces:
                        out.append((file, opener, start, block, "\n".join(held)))
                    held = []
                no += 1
            yield from flush()
        end()
        yield from flush()

    return lines.mapInArrow(cut, "_file string, _block bigint, _row bigint, part bigint, record string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _block, _row, record``: the records of CSV files, also those with newlines in quoted cells.

    Files are read in splits. A line (what ends at a line feed) starts inside or outside a quoted cell; a
    first pass parses each split under both states at once, the maps of the splits are composed in order,
    and with each split's true state records are cut at true line ends. A record that reaches over splits is
    put together from its pieces; only if there are any is the text read once more for that. Ordering by the first
    three columns is file order. Blank records and each file's first record (its header) are left out.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_block"))
    inside = _starts_inside(lines)
    records = _records(lines, inside, False).drop("part")
    if inside:
        # what was found holds for these splits only: a session that cuts files otherwise by then is told so
        size, block, length = (F.col(f"_metadata.{c}") for c in ("file_size", "file_block_start", "file_block_length"))
        most = text.agg(F.max(length)).first()[0]
        other = (length > most) | ((length < most) & (block + length < size)) | (block % most != 0)
        lines = text.where(F.when(other, F.raise_error(F.lit(
            "the files are split otherwise than when they were opened (spark.sql.files.maxPartitionBytes): open them again"))
            .cast("boolean")).otherwise(F.lit(True))).select(*lines.columns[:1], F.col("_metadata.file_path").alias("_file"),
                                                              F.col("_metadata.file_block_start").alias("_block"))
        pieces = _records(lines, inside, True)
        # the first piece knows the number of the record's first line, the others say -1
        whole = pieces.groupBy("_file", "_block").agg(F.max("_row").alias("_row"), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("part", "record"))), lambda x: x["record"]), "\n").alias("record"))
        records = _records(lines, inside, False).drop("part").unionByName(whole)
    header = (F.col("_block") == 0) & (F.col("_row") == 0)
    return records.where(~header & (F.trim(F.regexp_replace("record", "\r", "")) != "")).withColumn(
        "record", F.regexp_replace("record", "\r$", ""))


def read_csv(spark: SparkSession, path: str, infer_types: bool = True, na_tokens=None,
             with_order: bool = False) -> DataFrame:
    """Header row, comma separated, every column read as text, NA tokens to NULL, then typed.

    Quoted cells may hold newlines (kept as they are), and large files are still split between tasks
    (``read_records``). Rows with fewer cells than the header end in nulls; one with more raises.
    ``with_order`` adds ``_file``, ``_block`` and ``_row``: ordering by them is file order.
    """
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    cols = spark.read.options(**options).option("header", True).option("inferSchema", False).csv(path).columns
    # one column more than the header has: what a row says beyond the header lands there
    kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(cols))]
                        + [T.StructField(_BEYOND, T.StringType())])
    raw = read_records(spark, path).withColumn("r", F.from_csv("record", kind.simpleString()[7:-1].replace(":", " "), options))
    raw = raw.where(F.when(F.col("r")[_BEYOND].isNotNull(), F.raise_error(F.concat(
        F.lit(f"a row has more cells than the {len(cols)} of the header; the first is "), F.col("r")[_BEYOND]))
        .cast("boolean")).otherwise(F.lit(True)))
    tokens = NA_TOKENS if na_tokens is None else list(na_tokens)
    cells = [F.col("r")[f"c{i}"] for i in range(len(cols))]
    order = [F.col(o) for o in ORDER_COLUMNS] if with_order else []
    clean = raw.select(*[F.when(v.isin(tokens), F.lit(None).cast("string")).otherwise(v).alias(c)
                         for c, v in zip(cols, cells)], *order)
    if not infer_types:
        return clean
    types = infer_csv_types(clean.select(*[F.col(qcol(c)) for c in cols]))
    return clean.select(*[cast_expr(c, t) for c, t in types.items()], *order)


def infer_csv_types(df: DataFrame) -> dict[str, str]:
    """Narrowest of boolean, bigint, double, string that accepts every non-null value."""
    aggs = []
    for i, c in enumerate(df.columns):
        col = F.col(qcol(c))
        number = F.trim(col).rlike(NUMBER_PATTERN) | F.lower(F.trim(col)).isin(INFINITY_WORDS)
        aggs += [F.count(col).alias(f"n{i}"),
                 F.count_if(col.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
                 F.count_if(col.rlike(INT_PATTERN) & F.trim(col).try_cast("bigint").isNotNull()).alias(f"i{i}"),
                 F.count_if(number).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            out[c] = "string"
        elif row[f"b{i}"] == n:
            out[c] = "boolean"
        elif row[f"i{i}"] == n:
            out[c] = "bigint"
        elif row[f"d{i}"] == n:
            out[c] = "double"
        else:
            out[c] = "string"
    return out


def cast_expr(c: str, t: str):
    col = F.col(qcol(c))
    if t == "boolean":
        return F.when(col.isin(TRUE_TOKENS), F.lit(True)).when(col.isin(FALSE_TOKENS), F.lit(False)).alias(c)
    if t == "bigint":
        return F.trim(col).try_cast("bigint").alias(c)
    if t == "double":
        return to_number(col, T.StringType()).alias(c)
    return col.alias(c)


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, no index, one file per task (no single-file funnel through one task).
    Cells keep their outer spaces."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
