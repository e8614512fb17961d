"""Where intermediate tables and files of a job live.

All of it goes to the folder that the cluster names in ``spark.checkpoint.dir``,
which the driver and every executor share.  Only a local session that names none
gets a temporary folder of this machine.

Results are lazy and read these files, so an operator deletes only what its own
later steps have replaced.  The rest is the caller's to delete with ``sweep``, once
the results are written.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import json
import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 2000
_local: dict[str, str] = {}
#: Folders of this session that ``sweep`` may delete, and those of tables of ``cut``.
_made: dict[str, None] = {}
_held: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; an error if a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="arkloom-")
    return f"file://{_local[app]}"


def _trim() -> None:
    """Gives back what this process's allocators keep of memory freed already."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trim(spark: SparkSession) -> None:
    """``_trim`` for the driver, Python and JVM: compiling plans and code leaves the JVM hundreds of MB outside its heap."""
    _trim()
    jvm = spark._jvm
    with contextlib.suppress(Py4JJavaError):  # another JVM, or one before 17.0.9, has no such command
        # By reflection, as the server's own class is not open to callers.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def lean(f):
    """For generators that run in Python workers: frees the memory they leave, since idle workers stay."""

    @functools.wraps(f)
    def run(*args, **more):
        try:
            yield from f(*args, **more)
        finally:
            _trim()

    return run


def modest(spark: SparkSession) -> None:
    """Lets rows go to Python in batches of at most BATCH, so that memory on both sides is small; fewer stay fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared one (not yet created)."""
    modest(spark)
    path = f"{shared_root(spark)}/arkloom/{name}-{uuid.uuid4().hex}"
    _made[path] = None
    return path


def bounded(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Thin rows, to be broadcast if there are at most ``most``; Spark chooses the join for more."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


def path_of(table: DataFrame) -> str:
    """Where a table of ``cut`` lies."""
    return _held[table]


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, _held.pop(df))


def sweep(spark: SparkSession) -> None:
    """Deletes what this session's operators have written to the shared folder, but for tables to keep, and frees the
    driver's memory that they no longer use.

    For when every result so far is written: those not yet computed can't be any more.
    """
    for path in list(_made):
        _delete(spark, path)
    trim(spark)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again; ``sweep`` spares a table to keep.

    The lineage ends there, so a lost executor costs no earlier work, and what
    made the rows runs once however often the result is used.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _held[out] = path
    if keep:
        _made.pop(path)
    return out


def open_store(uri: str):
    """(file system, path) of a URI, for code in Python workers."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def save(arrays: dict[str, np.ndarray], uri: str) -> str:
    """One file: a line of JSON with each array's type and place, then the arrays."""
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, at, a.size]
        raw += bytes(-len(raw) % 64)
        body.append(raw)
        at += len(raw)
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as f:
        f.write(line + b"".join(body))
    return uri


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file of ``save``, mapped to memory; a file in another store is fetched first."""
    from pyarrow import fs

    store, path = open_store(uri)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as f, store.open_input_stream(path, compression=None) as g:
            f.write(g.read())
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
    stop = raw[: 1 << 20].tobytes().index(b"\n") + 1
    head = json.loads(raw[:stop].tobytes())
    out = {}
    for name, (kind, at, size) in head.items():
        dtype = np.dtype(kind)
        out[name] = raw[stop + at : stop + at + size * dtype.itemsize].view(dtype)
    return out
