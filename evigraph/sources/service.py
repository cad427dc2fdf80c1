"""Remote services as Spark sources and sinks: a search read page by page as a stream, and a graph written by keyed requests.

A service is a function that travels to the tasks; nothing here opens a connection. What fails is tried again; a request is safe to repeat, as reads change nothing and
writes are merges by key.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .literature import checked, with_retry


class Pace:
    """At most ``rate`` requests a second in each of ``tasks`` tasks' share: a token bucket of one token for every task.

    All tasks of a job together stay within the service's rate, however many run at once, as each has its share of it.
    """

    def __init__(self, rate: float, tasks: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = tasks / rate if rate > 0 else 0.0, clock, sleep
        self.next = clock()

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


# ---- a search as a stream --------------------------------------------------------------------------------------------------------
@dataclass
class Page(InputPartition):
    window: int
    start: int
    size: int
    tasks: int


class PagedReader(DataSourceStreamReader):
    """Offsets are ``window, page``: the next page to read. Each micro-batch is up to ``pages`` pages, a task each."""

    def __init__(self, options: dict[str, str], schema, count: Callable[[str], int], fetch: Callable[[str, int, int], list[tuple]]):
        self.windows = [w for w in options.get("windows", "").split(",") if w]
        self.size, self.pages, self.rate = int(options.get("size", 200)), int(options.get("pages", 8)), float(options.get("rate", 3))
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("wait", 5))
        self.count, self.fetch, self.counts = count, fetch, {}
        self.at = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"window": 0, "page": 0}

    def _pages(self, window: int) -> int:
        if window not in self.counts:
            found = with_retry(lambda: self.count(self.windows[window]), self.tries, self.pause)
            if found is None:
                raise RuntimeError(f"the service does not tell how much {self.windows[window]} has")
            self.counts[window] = found
        return -(-self.counts[window] // self.size)

    def _from(self, offset: dict) -> Iterator[tuple[int, int]]:
        window, page = offset["window"], offset["page"]
        while window < len(self.windows):
            while page < self._pages(window):
                yield window, page
                page += 1
            window, page = window + 1, 0

    def latestOffset(self) -> dict:
        steps = self._from(self.at)
        for _ in range(self.pages):
            if (step := next(steps, None)) is None:
                break
            self.at = {"window": step[0], "page": step[1] + 1}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end, key=lambda o: (o["window"], o["page"]))  # after a restart the stream goes on from what it has planned
        steps = []
        for w, p in self._from(start):
            if (w, p) >= (end["window"], end["page"]):
                break
            steps.append((w, p))
        return [Page(w, p * self.size, min(self.size, self.counts[w] - p * self.size), len(steps)) for w, p in steps]

    def read(self, partition: Page) -> Iterator[tuple]:
        pace = Pace(self.rate, partition.tasks)
        pace.wait()
        name, tries = self.windows[partition.window], self.tries
        rows = with_retry(lambda: self.fetch(name, partition.start, partition.size), tries, self.pause)
        if rows is None:
            raise RuntimeError(f"page {partition.start} of {name} cannot be read")  # the micro-batch is done anew, no page is passed over
        time.sleep(pace.gap)  # a task's next page may start in another worker
        yield from rows

    def commit(self, end: dict) -> None:
        pass


def pages(count: Callable[[str], int], fetch: Callable[[str, int, int], list[tuple]], row: str = "pmid string, xml string") -> type[DataSource]:
    """A streaming source ``literature_pages`` over the windows of a search.

    ``count(window)`` tells the hits of a window, ``fetch(window, start, size)`` gives the rows of a page. Options: ``windows`` (divided by commas), ``size`` of a page,
    ``pages`` of a micro-batch, ``rate`` (requests a second over all tasks), ``tries``, ``wait``. A stream that is started again goes on after the last
    page of its checkpoint; a page that cannot be read stops it, and none is lost.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "literature_pages"

        def schema(self) -> str:
            return row

        def streamReader(self, schema) -> DataSourceStreamReader:
            return PagedReader(self.options, schema, count, fetch)

    return Pages


# ---- a graph by keyed requests ---------------------------------------------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    rows: int
    requests: int


class KeyedWriter(DataSourceWriter):
    """Sends rows in requests of ``batch``; the driver hears what each task has sent and tells the service when all is there or nothing counts."""

    def __init__(self, options: dict[str, str], schema, send: Callable[[str, list[dict]], str], told: Callable[[str, dict], None]):
        self.kind, self.size = options.get("kind", "vertices"), int(options.get("batch", 500))
        self.tries, self.pause, self.rate, self.tasks = int(options.get("tries", 5)), float(options.get("wait", 1)), float(options.get("rate", 0)), int(options.get("tasks", 8))
        self.send, self.told = send, told

    def write(self, iterator: Iterator) -> Written:
        pace, held, done = Pace(self.rate, self.tasks), [], Written(0, 0)

        def flush() -> None:
            pace.wait()
            if with_retry(lambda: checked(self.send(self.kind, held)), self.tries, self.pause) is None:
                raise RuntimeError(f"{len(held)} {self.kind} cannot be written")
            done.rows += len(held)
            done.requests += 1

        for row in iterator:
            held.append(json.loads(json.dumps(row.asDict(recursive=True), default=str)))
            if len(held) == self.size:
                flush()
                held = []
        if held:
            flush()
        return done

    def commit(self, messages: list) -> None:
        sent = [m for m in messages if m is not None]
        self.told("commit", {"kind": self.kind, "rows": sum(m.rows for m in sent), "requests": sum(m.requests for m in sent)})

    def abort(self, messages: list) -> None:
        self.told("abort", {"kind": self.kind, "rows": sum(m.rows for m in messages if m is not None)})


def graph_service(send: Callable[[str, list[dict]], str], told: Callable[[str, dict], None] = lambda what, sums: None) -> type[DataSource]:
    """A sink ``graph_service``: rows of ``kind`` (``vertices`` or ``edges``) go to ``send(kind, rows)``, which merges them by their keys.

    Options: ``kind``, ``batch`` (rows of a request), ``tries``, ``wait``, ``rate`` (requests a second over ``tasks`` tasks). A request that fails, or whose answer
    is lost, is sent again, and so is all that a lost task had sent; as the service merges by key, each row is there once. ``told`` hears of the
    commit, with sums over all tasks, or of the abort.
    """

    class Service(DataSource):
        @classmethod
        def name(cls) -> str:
            return "graph_service"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return KeyedWriter(self.options, schema, send, told)

    return Service
