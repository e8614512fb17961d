"""Asynchronous jobs over the operator registry, their progress, and a small HTTP front end."""

from __future__ import annotations

import http.server
import json
import queue
import threading
import time
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from arkloom.operators import registry
from arkloom.session import settled


class Status(str, Enum):
    FAILED = "FAILED"
    KILLED = "KILLED"
    PREP = "PREP"
    RUNNING = "RUNNING"
    SUCCEEDED = "SUCCEEDED"
    UNKNOWN = "UNKNOWN"


class Disposition(str, Enum):
    QUEUE = "QUEUE_RESULTS"
    DISCARD = "DISCARD_RESULTS"
    NOTIFY = "NOTIFY"


@dataclass
class Request:
    operator: str
    params: dict
    request: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Request:
        try:
            raw = json.loads(text)
            return cls(raw["operator"], dict(raw.get("params", {})), dict(raw.get("request", {})))
        except (ValueError, KeyError, TypeError) as error:
            raise registry.ParameterError(f"not a request: {text[:100]}") from error


@dataclass
class JobState:
    name: str
    operator: str
    status: str = Status.PREP.value
    progress: int = 0
    jobs_running: int = 0
    runtime: float = 0.0
    bytes_written: int = 0
    error_code: int = 0
    message: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


class JobManager:
    """Runs operators in threads with a Spark job group each."""

    def __init__(self, spark: SparkSession, start_timeout: float = 20.0):
        self.spark, self.start_timeout = spark, start_timeout
        self.jobs: dict[str, tuple[JobState, Future, float]] = {}
        self.queues: dict[str, queue.Queue] = {}

    def submit(self, operator: str, params: dict, disposition: Disposition = Disposition.DISCARD, queue_name: str = "default", callback: Callable | None = None) -> JobState:
        """Starts an operator; an unknown one gives a failed state, as do bad parameters."""
        state, future = JobState(f"{operator}-{uuid.uuid4().hex[:8]}", operator), Future()
        self.jobs[state.name] = (state, future, time.time())

        def work():
            self.spark.sparkContext.setJobGroup(state.name, operator)
            try:
                out = registry.run(self.spark, operator, params)
                state.status = Status.RUNNING.value
                op = registry.REGISTRY[operator]
                rows = None
                if not any(params.get(d) for d in op.dest):
                    # Whole results, as tables in the shared folder; a client iterates over them.
                    rows = [settled(df, "result") for df in (out if isinstance(out, tuple) else (out,))]
                state.status, state.progress = Status.SUCCEEDED.value, 100
                future.set_result(rows)
            except Exception as error:  # noqa: BLE001
                if not isinstance(error, registry.OperatorError) and not self.spark.sparkContext.statusTracker().getJobIdsForGroup(state.name):
                    error = registry.StartError(f"{type(error).__name__}: {error}")
                state.status, state.error_code, state.message = Status.FAILED.value, 1, f"{type(error).__name__}: {error}"[:2000]
                future.set_exception(error)
            state.runtime = time.time() - self.jobs[state.name][2]
            if disposition is Disposition.QUEUE:
                self.queues.setdefault(queue_name, queue.Queue()).put(state)
            elif disposition is Disposition.NOTIFY and callback:
                callback(state)

        InheritableThread(target=work, daemon=True).start()
        return state

    def progress(self, name: str) -> JobState:
        if name not in self.jobs:
            return JobState(name, "", Status.UNKNOWN.value, error_code=2, message="no such job")
        state, future, began = self.jobs[name]
        if not future.done():
            tracker = self.spark.sparkContext.statusTracker()
            ids = tracker.getJobIdsForGroup(name)
            stages = [tracker.getStageInfo(s) for j in ids if (info := tracker.getJobInfo(j)) for s in info.stageIds]
            stages = [s for s in stages if s]
            done, total = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
            state.jobs_running = sum(1 for j in ids if (info := tracker.getJobInfo(j)) and info.status == "RUNNING")
            state.progress, state.runtime = (100 * done // total if total else 0), time.time() - began
            if ids:
                state.status = Status.RUNNING.value
            elif state.runtime > self.start_timeout and state.status == Status.PREP.value:
                state.status, state.error_code, state.message = Status.FAILED.value, 3, f"StartError: nothing ran within {self.start_timeout} s"
                self.spark.sparkContext.cancelJobGroup(name)
        return state

    def wait(self, name: str, timeout: float = 600.0, poll: float = 0.5) -> JobState:
        end = time.time() + timeout
        while time.time() < end:
            state = self.progress(name)
            if state.status in (Status.SUCCEEDED.value, Status.FAILED.value, Status.KILLED.value, Status.UNKNOWN.value):
                return state
            time.sleep(poll)
        return self.progress(name)

    def result(self, name: str):
        return self.jobs[name][1].result()

    def kill(self, name: str) -> JobState:
        self.spark.sparkContext.cancelJobGroup(name)
        state = self.jobs[name][0]
        if state.status not in (Status.SUCCEEDED.value, Status.FAILED.value):
            state.status = Status.KILLED.value
        return state

    def drain(self, queue_name: str = "default") -> list[JobState]:
        """The states that have come to a queue since it was last drained."""
        waiting, out = self.queues.setdefault(queue_name, queue.Queue()), []
        while not waiting.empty():
            out.append(waiting.get())
        return out

    def echo(self, text: str) -> str:
        return text

    # Typed conveniences.
    def warc_ngrams(self, path: str, arity: int = 2, dest: str | None = None, **more) -> JobState:
        return self.submit("warcNgrams", {"WARC_FILE": path, "ARITY": arity} | ({"NGRAM_DEST": dest} if dest else {}) | more)

    def ngram_frequencies(self, path: str, dest: str | None = None) -> JobState:
        return self.submit("ngramFrequencies", {"NGRAM_FILE": path} | ({"FREQS_DEST": dest} if dest else {}))

    def iterate(self, df: DataFrame):
        return df.toLocalIterator()


def serve(manager: JobManager, port: int = 0) -> http.server.ThreadingHTTPServer:
    """Serves requests by POST on the loopback interface.

    ``getJobStatus``, ``getQueue``, ``killJob`` and ``testCall`` are built in.  The part ``request`` of a request may
    name a disposition, its queue, and a port of this machine that is told when the job ends.
    """

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            try:
                r = Request.from_json(body)
                if r.operator == "getJobStatus":
                    out, code = manager.progress(r.params.get("jobName", "")).to_json(), 200
                elif r.operator == "testCall":
                    out, code = json.dumps({"echo": r.params}), 200
                elif r.operator == "getQueue":
                    out, code = json.dumps([asdict(s) for s in manager.drain(r.params.get("queue", "default"))]), 200
                elif r.operator == "killJob":
                    out, code = manager.kill(r.params.get("jobName", "")).to_json(), 200
                else:
                    how, port = Disposition(r.request.get("disposition", Disposition.DISCARD.value)), r.request.get("notifyPort")
                    tell = (lambda s: post(int(port), Request("jobDone", asdict(s)))) if port else None
                    out, code = manager.submit(r.operator, r.params, how, r.request.get("queue", "default"), tell).to_json(), 200
            except (registry.OperatorError, ValueError, KeyError) as error:
                out, code = json.dumps({"error": type(error).__name__, "message": str(error)}), 400
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(out.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def post(port: int, request: Request, timeout: float = 30.0) -> dict:
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}/", request.to_json().encode()), timeout=timeout) as r:
            return json.loads(r.read())
    except OSError as error:
        raise registry.CommunicationError(str(error)) from error
