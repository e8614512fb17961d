"""Decisions about rows, made on thin tables and carried back without moving texts.

A row of a table in Parquet files is known by its place: its file, as a hash of the
path, and its number there.  Decisions are thin rows (place, value).  They are
dealt by runs of 2**RUN rows of a file, and each run is written as one small file of
the shared folder, so its size is bounded.  Tasks that read the table again look up
the runs that they come through.  No text passes a shuffle, nothing is broadcast.

Defined results: rows without a decision have the default value; an empty table
gives an empty result; a table that isn't read straight from Parquet files is
written to some first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, lean, open_store, work_dir

FILE, ROW = "__file", "__row"
#: log2 of the rows of a run.
RUN = 16


def _plain(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a file, once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def placed(df: DataFrame) -> DataFrame:
    """``df`` with the columns FILE and ROW."""
    place = [F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").cast("long").alias(ROW)]
    if _plain(df):
        try:
            return df.select("*", *place)
        except AnalysisException:
            pass  # files of another kind have no row numbers
    return cut(df, "rows").select("*", *place)


def _name(file: int, run: int) -> str:
    return f"{file & (1 << 64) - 1:016x}-{run}"


@lean
def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    at, held = None, []

    def close() -> pa.RecordBatch:
        rows, values = (np.concatenate(x) for x in zip(*held, strict=True))
        # Under its name a file is whole: a task that runs twice writes the same, and moves it there.
        part = f"{path}/{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as f:
            f.write(rows.astype("<i8").tobytes() + values.astype("<i8").tobytes())
        store.move(part, f"{path}/{_name(*at)}")
        return pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        file, row, value = (batch.column(i).to_numpy() for i in range(3))
        run = row >> RUN
        edge = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (run[1:] != run[:-1])))
        for s, e in zip(edge, [*edge[1:], len(row)], strict=True):
            own = (int(file[s]), int(run[s]))
            if own != at:
                if at is not None:
                    yield close()
                at, held = own, []
            held.append((row[s:e].copy(), value[s:e].copy()))
    if at is not None:
        yield close()


def write_marks(marks: DataFrame) -> str:
    """Writes decisions (FILE, ROW, value), at most one a place; returns their folder."""
    folder = work_dir(marks.sparkSession, "marks")
    rows = marks.select(FILE, ROW, F.col("value").cast("long").alias("value"))
    dealt = rows.repartition(FILE, F.shiftright(ROW, RUN)).sortWithinPartitions(FILE, ROW)
    dealt.mapInArrow(lambda it: _write(it, folder), "n long").agg(F.sum("n")).collect()
    return folder


class Marks:
    """Looks up the decisions for rows of places."""

    def __init__(self, folder: str, default: int):
        self.store, self.path = open_store(folder)
        self.default = default
        self.runs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def run(self, file: int, run: int) -> tuple[np.ndarray, np.ndarray]:
        if (file, run) not in self.runs:
            self.runs.clear() if len(self.runs) > 16 else None
            name = f"{self.path}/{_name(file, run)}"
            raw = b""
            if self.store.get_file_info(name).is_file:
                with self.store.open_input_file(name) as f:
                    raw = f.read()
            self.runs[file, run] = tuple(np.frombuffer(raw, "<i8").reshape(2, -1))
        return self.runs[file, run]

    def values(self, file: pa.Array, row: pa.Array) -> np.ndarray:
        file, row = file.to_numpy(), row.to_numpy()
        out = np.full(len(row), self.default, np.int64)
        if not len(row):
            return out
        run = row >> RUN
        edge = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (run[1:] != run[:-1])))
        for s, e in zip(edge, [*edge[1:], len(row)], strict=True):
            rows, values = self.run(int(file[s]), int(run[s]))
            if len(rows):
                at = np.minimum(np.searchsorted(rows, row[s:e]), len(rows) - 1)
                hit = rows[at] == row[s:e]
                out[s:e][hit] = values[at[hit]]
        return out


@lean
def _take(batches: Iterator[pa.RecordBatch], folder: str, default: int) -> Iterator[pa.RecordBatch]:
    marks = Marks(folder, default)
    for batch in batches:
        n = marks.values(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))
        rows = batch.select(batch.schema.names[:-2])
        for i in range(int(n.max(initial=0))):
            yield rows if (n > i).all() else rows.filter(pa.array(n > i))


def taken(rows: DataFrame, folder: str, default: int = 1) -> DataFrame:
    """The rows of a table of ``placed``, each as often as its decision says, without FILE and ROW."""
    own = [c for c in rows.columns if c not in (FILE, ROW)]
    schema = rows.select(*own).schema
    return rows.select(*own, FILE, ROW).mapInArrow(lambda it: _take(it, folder, default), schema)
