"""Progress of running transfers from a stream of their chunks.

The batch form (:func:`courier.operators.transfer_progress`) needs all chunks. Here they come as they
are confirmed, in any order and any number of micro-batches: each says where it starts in its object
and how long it is, as the parts of an upload do. Per transfer the state holds how far the bytes from
the start are complete and the chunks beyond the first gap; a milestone is emitted when the gaps before
it are filled, so the milestones of a transfer are those of the batch form, whatever the order of
arrival. A timer that is set anew with every chunk reports transfers that stand still.

The chunks that wait lie in the state as sorted runs, cut into pages, and are merged page by page when
the gap before them closes: a task holds ``BUFFER`` new chunks and one page of each run, however many
chunks a transfer or a micro-batch has.
"""

import heapq
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: New chunks that a task sorts in memory; more become a run of the state.
BUFFER = 1 << 17
#: Chunks of a page, the unit in which a run is written and read.
PAGE = 1024
#: Runs of a transfer; more are merged into one.
RUNS = 64


def chunk_order(chunk) -> tuple:
    return chunk[0], -chunk[1]


def count_chunk(done: int, total: int, chunk, step: int):
    """``done`` after a chunk that starts at or before it, and the percentage if that is a milestone."""
    end = max(done, chunk[0] + chunk[1])
    pct = end * 100 // total
    return end, pct if pct // step > done * 100 // total // step else None


def advance(done: int, total: int, chunks: list, step: int):
    """Move ``done`` over the chunks (start, length, id, …) that follow without a gap.

    Returns the new ``done``, the chunks that wait for a gap, and the milestones ``(chunk, done,
    pct)``. Chunks that were counted already are dropped, the counted part of an overlapping one too.
    """
    found, waiting = [], []
    for chunk in sorted(chunks, key=chunk_order):
        if chunk[0] > done:
            waiting.append(chunk)
            continue
        done, pct = count_chunk(done, total, chunk, step)
        if pct is not None:
            found.append((chunk, done, pct))
    return done, waiting, found


class TransferProgress(StatefulProcessor):
    """State of one transfer: ``done`` and ``total`` bytes, the chunks behind gaps, and a stall timer.

    ``runs`` lists the sorted runs of waiting chunks, the oldest first: number, chunks taken off its front,
    chunks. ``pages`` has their chunks. ``waiting`` is where earlier versions kept them; what a checkpoint
    has there becomes a run.
    """

    def __init__(self, step: int, stall_ms: int, columns: Sequence[str], ids: T.StructType, forget_ms: int | None):
        self.step, self.stall_ms, self.columns, self.ids, self.forget_ms = step, stall_ms, list(columns), ids, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "done long, total long", self.forget_ms)
        chunk = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), *self.ids.fields])
        self.waiting = handle.getListState("waiting", chunk, self.forget_ms)
        self.runs = handle.getListState("runs", "run long, taken long, size long", self.forget_ms)
        self.pages = handle.getMapState("pages", "run long, page long", T.StructType([T.StructField("chunks", T.ArrayType(chunk))]),
                                        self.forget_ms)

    def _rows(self, key, kind, items):
        import pandas as pd

        rows = [(*key, *chunk[2:], kind, done, pct) for chunk, done, pct in items]
        return pd.DataFrame(rows, columns=self.columns)

    def _read(self, run: int, taken: int, size: int) -> Iterator:
        """The chunks of a run that are left, in order, a page at a time."""
        for page in range(taken // PAGE, -(-size // PAGE)):
            chunks = self.pages.getValue((run, page))[0]
            yield from map(tuple, chunks[max(0, taken - page * PAGE):])

    def _write(self, run: int, chunks: Iterable) -> tuple:
        chunks, size = iter(chunks), 0
        while page := list(islice(chunks, PAGE)):
            self.pages.updateValue((run, size // PAGE), (page,))
            size += len(page)
        return run, 0, size

    def _remove(self, run: int, taken: int, size: int, upto: int) -> None:
        """Drop the pages of which ``upto`` leaves no chunk."""
        for page in range(taken // PAGE, -(-size // PAGE) if upto == size else upto // PAGE):
            self.pages.removeKey((run, page))

    def _add(self, runs: list, chunks: list) -> list:
        """Sorted chunks become a run; too many runs become one."""
        run = runs[-1][0] + 1 if runs else 0
        runs = [*runs, self._write(run, chunks)]
        if len(runs) <= RUNS:
            return runs
        whole = self._write(run + 1, heapq.merge(*(self._read(*r) for r in runs), key=chunk_order))
        for r in runs:
            self._remove(*r, r[2])
        return [whole]

    def _arrived(self, rows, seen: list) -> Iterator:
        """The chunks of a micro-batch; ``seen[0]`` becomes the largest total."""
        if self.waiting.exists():
            yield from self.waiting.get()
            self.waiting.clear()
        for pdf in rows:
            seen[0] = max(seen[0], int(pdf["total"].fillna(0).max()))
            pdf = pdf[(pdf["length"] > 0) & pdf["start"].notna()]
            ids = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in self.ids.names]
            yield from ((int(s), int(n), *i) for s, n, *i in zip(pdf["start"], pdf["length"], *ids))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        done, total = self.at.get() if self.at.exists() else (0, 0)
        runs = list(self.runs.get()) if self.runs.exists() else []
        had_runs, seen = bool(runs), [total]
        arrived, new = self._arrived(rows, seen), []
        while more := list(islice(arrived, BUFFER)):
            if new:
                runs = self._add(runs, new)
            new = sorted(more, key=chunk_order)
        total = seen[0]
        if total <= 0:  # nothing to take a share of
            for r in runs:
                self._remove(*r, r[2])
            yield pd.DataFrame([], columns=self.columns)
            return

        def numbered(i, chunks):
            return ((i, c) for c in chunks)

        sources = [*(self._read(*r) for r in runs), new]  # the oldest first: of equal chunks the first counts
        taken, found = [*(r[1] for r in runs), 0], []
        for i, chunk in heapq.merge(*(numbered(i, s) for i, s in enumerate(sources)), key=lambda c: chunk_order(c[1])):
            if chunk[0] > done:
                break
            taken[i] += 1
            done, pct = count_chunk(done, total, chunk, self.step)
            if pct is not None:
                found.append((chunk, done, pct))
                if len(found) >= PAGE:  # a total that is too small has milestones beyond 100 percent
                    yield self._rows(key, "progress", found)
                    found = []
        self.at.update((done, total))
        for r, upto in zip(runs, taken):
            self._remove(*r, upto)
        runs = [(run, upto, size) for (run, _, size), upto in zip(runs, taken) if upto < size]
        if self.forget_ms:  # what still waits is as young as the transfer's last change
            for run, upto, size in runs:
                for page in range(upto // PAGE, -(-size // PAGE)):
                    self.pages.updateValue((run, page), self.pages.getValue((run, page)))
        if new := new[taken[-1]:]:
            runs = self._add(runs, new)
        if runs:
            self.runs.put(runs)
        elif had_runs:
            self.runs.clear()
        if self.stall_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if done < total:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall_ms)
        yield self._rows(key, "progress", found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if not self.at.exists():
            yield pd.DataFrame([], columns=self.columns)
            return
        done, total = self.at.get()
        nothing = (0, 0, *[None] * len(self.ids.names))
        yield self._rows(key, "stalled", [(nothing, done, done * 100 // total)])

    def close(self) -> None:
        pass


def stream_transfer_progress(chunks: DataFrame, transfer_cols: Sequence[str], id_cols: Sequence[str], *, start_col: str,
                             n_col: str, total_col: str, step: int = 10, stall_s: float = 0,
                             forget_s: float | None = None) -> DataFrame:
    """A streaming DataFrame of milestones: ``(*transfer_cols, *id_cols, kind, done, pct)``.

    ``kind`` is ``progress`` (the chunk that completes the bytes up to a new multiple of ``step``
    percent of ``total_col``) or, with ``stall_s``, ``stalled`` (no chunk for that long before the end;
    null ids), once per silence. With ``forget_s`` the state of a transfer is dropped so long after
    its last change; without it a repeated chunk of a finished transfer is known for ever.

    Chunks without bytes, without a start, or counted before emit nothing; a transfer of 0 bytes emits
    nothing. A micro-batch's chunks of one transfer are read by one task, in Arrow batches; those that
    wait lie in the state store, so the task's memory does not grow with them. With ``stall_s`` use a processing-time trigger: timers keep the query
    running when no data is left. Needs the RocksDB state store (the session helpers set it).
    """
    taken = {c.lower() for c in [*transfer_cols, *id_cols]}
    if taken & {"kind", "done", "pct"} or len(taken) < len(transfer_cols) + len(id_cols):
        raise ValueError("transfer and id columns must differ from each other and from kind, done, pct")
    spark = chunks.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    # columns under names of our own: the rows reach Python as named tuples
    own = {**{c: f"k{i}" for i, c in enumerate(transfer_cols)}, **{c: f"i{i}" for i, c in enumerate(id_cols)}}
    rows = chunks.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(start_col).cast("long").alias("start"),
                         F.col(n_col).cast("long").alias("length"), F.col(total_col).cast("long").alias("total"))
    ids = T.StructType([T.StructField(own[c], rows.schema[own[c]].dataType) for c in id_cols])
    out = T.StructType([*[T.StructField(own[c], rows.schema[own[c]].dataType) for c in transfer_cols], *ids.fields,
                        *T._parse_datatype_string("kind string, done long, pct long").fields])
    processor = TransferProgress(step, int(stall_s * 1000), out.names, ids, int(forget_s * 1000) if forget_s else None)
    found = rows.groupBy(*[own[c] for c in transfer_cols]).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append",
        timeMode="ProcessingTime" if stall_s else "None")
    return found.withColumnsRenamed({n: c for c, n in own.items()})
