"""Table versions as Parquet snapshots in a shared folder, with undo/redo and diff.

Each snapshot is written once, to a folder of its own, and never again. ``root/_log`` is a table of
states that only grows: each record names the snapshots of the history and the one that is current,
and the last record counts. Undo and redo only add a record; applying after an undo leaves the
redo snapshots out of the next record (their folders stay, frames may still read them). Nothing is
kept in the handle, so that several handles see each other's steps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.contracts import qcol

_STATE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()),
                       T.StructField("current", T.IntegerType()), T.StructField("snapshots", T.ArrayType(T.StringType()))])


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, initial: DataFrame | None = None):
        """Start a new history at ``root`` from ``initial``, or attach to an existing one."""
        self.spark = spark
        self.root = root.rstrip("/")
        if initial is not None:
            self._append(0, 0, [self._snapshot(initial)])

    # -- storage --
    def _snapshot(self, df: DataFrame) -> str:
        name = f"snapshot-{uuid.uuid4().hex}"
        df.write.mode("error").parquet(f"{self.root}/{name}")
        return name

    def _append(self, seq: int, current: int, snapshots: list[str]) -> None:
        record = self.spark.createDataFrame([(seq, uuid.uuid4().hex, current, snapshots)], _STATE)
        record.coalesce(1).write.mode("append").json(f"{self.root}/_log")

    def _state(self) -> tuple[int, int, list[str]]:
        log = self.spark.read.schema(_STATE).json(f"{self.root}/_log")
        last = log.agg(F.max_by(F.struct("seq", "current", "snapshots"), F.struct("seq", "id")).alias("s")).first()["s"]
        return last["seq"], last["current"], list(last["snapshots"])

    # -- the state machine --
    def apply(self, df: DataFrame) -> int:
        name = self._snapshot(df)
        seq, current, snapshots = self._state()
        self._append(seq + 1, current + 1, [*snapshots[: current + 1], name])
        return current + 1

    def _move(self, step: int) -> bool:
        seq, current, snapshots = self._state()
        if not 0 <= current + step < len(snapshots):
            return False
        self._append(seq + 1, current + step, snapshots)
        return True

    def undo(self) -> bool:
        return self._move(-1)

    def redo(self) -> bool:
        return self._move(1)

    def can_undo(self) -> bool:
        return self._state()[1] > 0

    def can_redo(self) -> bool:
        _, current, snapshots = self._state()
        return current + 1 < len(snapshots)

    def current_version(self) -> int:
        return self._state()[1]

    def version(self, n: int) -> DataFrame:
        snapshots = self._state()[2]
        if not 0 <= n < len(snapshots):
            raise ValueError(f"version {n} does not exist (0..{len(snapshots) - 1}).")
        return self.spark.read.parquet(f"{self.root}/{snapshots[n]}")

    def current(self) -> DataFrame:
        return self.version(self.current_version())

    def schema_diff(self, a: int, b: int) -> DataFrame:
        """``column, type_a, type_b`` of the columns that were added (no type_a), dropped or retyped."""
        ta, tb = (dict(self.version(n).dtypes) for n in (a, b))
        rows = [(c, ta.get(c), tb.get(c)) for c in dict.fromkeys([*ta, *tb]) if ta.get(c) != tb.get(c)]
        return self.spark.createDataFrame(rows, "column string, type_a string, type_b string")

    def diff(self, a: int, b: int) -> DataFrame:
        """Rows added and removed going from version a to b, and in how many ``copies``.

        Columns of either version count (missing ones are null), and a column whose type changed is
        compared as text. One aggregate of signed copies (+1 in b, -1 in a) per distinct row,
        combined map-side: many copies of one row cost one row per task.
        """
        va, vb = self.version(a), self.version(b)
        ta, tb = dict(va.dtypes), dict(vb.dtypes)
        cols = list(dict.fromkeys([*ta, *tb]))

        def side(df: DataFrame, own: dict, other: dict, sign: int) -> DataFrame:
            def cell(c: str):
                kind = own.get(c, other.get(c)) if own.get(c, other.get(c)) == other.get(c, own.get(c)) else "string"
                return (F.col(qcol(c)) if c in own else F.lit(None)).cast(kind).alias(c)

            return df.select(*[cell(c) for c in cols], F.lit(sign).alias("__d"))

        signed = side(va, ta, tb, -1).unionByName(side(vb, tb, ta, 1))
        keys = [F.col(qcol(c)) for c in cols]
        net = signed.groupBy(*keys).agg(F.sum("__d").alias("__net")).where(F.col("__net") != 0)
        return net.select(F.when(F.col("__net") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"),
                          *keys, F.abs("__net").alias("copies"))


# The actions a version log may hold.
ACTIONS = ("apply", "undo", "redo")


def replay_version_log(log: DataFrame, session_col: str, seq_col: str, action_col: str) -> DataFrame:
    """Replay apply/undo/redo logs per session to (current_index, n_versions, can_undo, can_redo).

    The state machine is a sequential fold, so each session's actions are sorted and
    folded with ``aggregate`` inside one row; sessions are spread across tasks by the
    ``groupBy`` shuffle. Unknown actions leave the state unchanged.
    """
    per = log.groupBy(F.col(session_col).alias("session")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("seq"), F.col(action_col).alias("action"))))
        .alias("acts"))
    start = F.struct(F.lit(0).alias("cur"), F.lit(1).alias("length"))

    def step(st, x):
        cur, length, act = st["cur"], st["length"], x["action"]
        new_cur = (F.when(act == "apply", cur + 1).when((act == "undo") & (cur > 0), cur - 1)
                   .when((act == "redo") & (cur < length - 1), cur + 1).otherwise(cur))
        new_len = F.when(act == "apply", cur + 2).otherwise(length)
        return F.struct(new_cur.alias("cur"), new_len.alias("length"))

    final = per.select("session", F.aggregate("acts", start, step).alias("st"))
    return final.select(F.col("session").alias(session_col), F.col("st.cur").alias("current_index"),
                        F.col("st.length").alias("n_versions"), (F.col("st.cur") > 0).alias("can_undo"),
                        (F.col("st.cur") < F.col("st.length") - 1).alias("can_redo"))
