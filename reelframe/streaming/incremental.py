"""Incremental operators: settled files, periodic refresh of touched films, resumable enrichment, replays."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelframe.functions.ranks import numbered
from reelframe.sources.tables import folder

from .ledger import Ledger

LISTING = "path string, size long, mtime long, seen timestamp"


class _Settling(StatefulProcessor):
    """Size and time of the paths of a bucket as last listed, as one value, with a timer for the moment when the next of
    them counts as settled or is forgotten. Paths are gone through as columns, not one by one."""

    def __init__(self, wait: float, keep: float, by_clock: bool):
        self.wait, self.keep, self.by_clock = int(wait * 1000), int(keep * 1000), by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getValueState("files", "listed binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        yield from self._advanced(listed_anew(self._read(), pd.concat(list(rows)), now if self.by_clock else None), now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(self._read(), max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()

    def _read(self) -> pd.DataFrame:
        if not self.files.exists():
            return pd.DataFrame(columns=STATE)
        return pa.ipc.open_stream(bytes(self.files.get()[0])).read_pandas()

    def _advanced(self, files: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        """What has settled by now; the rest of the state is written, and its next timer set."""
        stood = ~files.told & ((files["last"] - files["first"] >= self.wait) | (files["first"] + self.wait <= now))
        if stood.any():
            yield files.loc[stood, ["path", "size", "mtime"]]
        files = files.assign(told=files.told | stood)
        files = files[~files.told | (files["last"] + self.keep > now)]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if files.empty:
            self.files.clear()
            return
        table, out = pa.Table.from_pandas(files, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as to:
            to.write_table(table)
        self.files.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int((files["last"] + self.keep).where(files.told, files["first"] + self.wait).min()))


STATE = ["path", "size", "mtime", "first", "last", "told"]


def listed_anew(files: pd.DataFrame, rows: pd.DataFrame, clock: int | None) -> pd.DataFrame:
    """The state of files, one row a path, after listings (path, size, mtime, at) in any order.

    A path's state is the latest listing's size and time, first and last listed so without another in between. Listings
    older than the state count only where they say the same: they make first earlier. With a clock, listings come after
    the state, in their own order, and their time is the clock's."""
    at = rows["at"] if clock is None else clock
    new = rows[["path", "size", "mtime"]].assign(first=at, last=at, told=False, order=rows["at"], listed=True)
    old = files.assign(order=files["last"] if clock is None else -(2**62), listed=False)
    both = pd.concat([old, new], ignore_index=True) if len(old) else new
    code = pd.factorize(both["path"], use_na_sentinel=False)[0]
    by = np.lexsort((both.listed, both["size"], both.mtime, both.order, code))
    both, code = both.iloc[by], code[by]
    size, mtime, first, last = (both[c].to_numpy("int64", copy=True) for c in ("size", "mtime", "first", "last"))
    listed, place = both.listed.to_numpy(bool), np.arange(len(both))
    state = np.full(code[-1] + 1, -1)  # where the state of each path is
    state[code[~listed]] = place[~listed]
    mine = state[code]
    early = place < mine
    same = early & (size == size[mine]) & (mtime == mtime[mine])
    np.minimum.at(first, mine[same], first[same])
    left = ~early
    both, code, size, mtime, first, last = both[left], code[left], size[left], mtime[left], first[left], last[left]
    turn = np.r_[True, (code[1:] != code[:-1]) | (size[1:] != size[:-1]) | (mtime[1:] != mtime[:-1])]
    head, ends = np.flatnonzero(turn)[np.cumsum(turn) - 1], np.r_[code[1:] != code[:-1], True]
    run = head[ends]
    told = both.told.to_numpy(bool)[run]
    return pd.DataFrame({"path": both["path"].to_numpy()[ends], "size": size[ends], "mtime": mtime[ends], "first": first[run], "last": np.maximum(last[ends], last[run]), "told": told})


def settled(listings: DataFrame, wait: float = 20.0, keep: float = 86_400.0, late: str | None = None, buckets: int = 1024) -> DataFrame:
    """(path, size, mtime) of files that haven't changed for wait seconds since they were first listed so.

    A file that is still growing starts anew at each change; a settled one is reported once until it changes again. No
    further listing of the file is needed: a timer reports it. Paths that no listing has shown for keep seconds are
    forgotten, so the state is as large as what is listed. Time is the clock's; with late, it is the listings' own (seen)
    and goes on with the latest of all listings less that delay, within which they may come in any order.

    State and timers are those of buckets of paths, by a hash, so that Python is asked for each bucket and not for each
    path; a batch rewrites the buckets that it touches. A checkpoint goes with its number of buckets."""
    spark = listings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = listings if late is None else listings.withWatermark("seen", late)
    rows = rows.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"), "path", "size", "mtime", "seen", F.unix_millis("seen").alias("at"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Settling(wait, keep, late is None), "path string, size long, mtime long", "Append", "ProcessingTime" if late is None else "EventTime")


def refresh(shots: DataFrame, path: str, checkpoint: str, **trigger):
    """A query that publishes anew the films that a batch touches, with the latest row of each shot, in a ledger at path.

    Readers take Ledger.latest(..., "film_id"): they see a film as it was before or after a batch, never between."""

    def publish(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, path)
        old = ledger.latest(batch.schema, "film_id").join(batch.select("film_id").distinct(), "film_id", "left_semi")
        # of equal versions the row that is greatest as text
        order = F.struct("version", F.to_json(F.struct(*batch.columns)))
        rows = old.unionByName(batch).groupBy("film_id", "n").agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        ledger.append(number, rows)

    return shots.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def enriched(work: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 64, together: list[str] | None = None, order: str | None = None) -> DataFrame:
    """fn applied to batches of rows in order; a batch that fails gives its rows with nulls and the error.

    fn is the caller's (a model client, say); schema names its columns, error is added. With together, a batch holds rows
    of one group only, in the given order: groups are put in order within tasks, none is gathered. Without it, the rows
    stay in their tasks: few bytes of them may be much work, so spread() them first."""
    names = [f.split()[0] for f in schema.split(", ")]
    keys = work.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema)
    if together:
        work = spread(work, *together).sortWithinPartitions(*together, order)

    def ask(rows: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        made: dict[tuple, list[pd.DataFrame]] = {}  # answers by their types, so that putting them together changes none
        failed = []
        for a, b in zip(starts, starts[1:], strict=False):
            try:
                answer = fn(rows.iloc[a:b].reset_index(drop=True))[names]
                made.setdefault(tuple(answer.dtypes), []).append(answer.set_axis(range(a, b)))
            except Exception as reason:  # the caller's function may raise anything; the row tells what
                failed.append(pd.DataFrame({"error": str(reason)}, index=range(a, b)))
        for answers in made.values():
            yield _beside(rows[keys], pd.concat(answers)).assign(error=None)
        if failed:
            error = pd.concat(failed)
            yield _beside(rows[keys], pd.DataFrame({n: None for n in names}, index=error.index, dtype=object)).assign(error=error["error"].to_numpy())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in filter(len, parts):
            held = (part if held is None else pd.concat([held, part])).reset_index(drop=True)
            starts = _starts(held, batch, together)
            yield from ask(held, starts)
            held = held.iloc[starts[-1] :]  # may go on in the next part
        if held is not None and len(held):
            yield from ask(held.reset_index(drop=True), [0, len(held)])

    return work.mapInPandas(run, f"{kinds}, {schema}, error string")


def spread(rows: DataFrame, *by: str | Column) -> DataFrame:
    """rows over as many tasks as there are shuffle partitions, or cores if those are more, however few bytes they have."""
    return rows.repartition(_tasks(rows), *by)


def _tasks(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _beside(rows: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
    """The rows that made is about, with its columns."""
    return pd.concat([rows.loc[made.index].reset_index(drop=True), made.reset_index(drop=True)], axis=1)


def _starts(rows: pd.DataFrame, batch: int, together: list[str] | None) -> list[int]:
    """Where batches begin: at each change of group, and after so many rows of one."""
    if not together:
        return list(range(0, max(len(rows), 1), batch))
    new = (rows[together] != rows[together].shift()).any(axis=1).to_numpy()
    heads = [*new.nonzero()[0].tolist(), len(rows)]
    return [x for a, b in zip(heads, heads[1:], strict=False) for x in range(a, b, batch)]


def once(items: DataFrame, key: str, signature: list[str], at: str | None = None, late: str = "1 day") -> DataFrame:
    """Redelivered items with the same signature are dropped; in a stream, those that come within the delay late, by the
    time in the column at, which bounds the state."""
    if not items.isStreaming:
        return items.dropDuplicates([key, *signature])
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark([key, *signature])


def upserted(items: DataFrame, key: str, signature: list[str], at: str, path: str, checkpoint: str, late: str = "1 day", **trigger):
    """A query that keeps the latest item of each key in a ledger at path: the same signature again changes nothing,
    another one replaces the item, an older one doesn't. Readers take Ledger.latest(..., key)."""

    def merge(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, path)
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(at, *signature)).alias("r")).select("r.*")
        old = ledger.latest(batch.schema, key).select(key, F.struct(*signature).alias("_old"), F.col(at).alias("_at"))
        changed = newest.join(old, key, "left").where(F.col("_old").isNull() | ~F.struct(*signature).eqNullSafe(F.col("_old")) & (F.col(at) >= F.col("_at")))
        ledger.append(number, changed.select(batch.columns))

    return once(items, key, signature, at, late).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def resumed(work: DataFrame, path: str, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, portion: int, batch: int = 64) -> DataFrame:
    """enriched() in portions of so many rows, each committed to a ledger at path once it and those before it are written;
    rows whose portion was committed by an earlier run aren't asked again. Gives all committed rows.

    Small portions are written side by side, as many as give each core sixteen batches, and committed in their order.
    What a run that dies had written of them and not committed is asked again."""
    spark, ledger, parts = work.sparkSession, Ledger(work.sparkSession, path), folder(work.sparkSession)
    made = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema), schema, "error string"])
    done, seen = ledger.read(made), Observation()
    left = numbered(work.join(done.select(keys), keys, "left_anti"), [], [F.asc(k) for k in keys], "_pos").withColumn("_portion", F.floor((F.col("_pos") - 1) / portion))
    # each portion has a folder, so that its job reads nothing else and its plan holds no number of its own to compile
    left.observe(seen, F.max("_pos").alias("rows")).write.partitionBy("_portion").option("compression", "zstd").parquet(parts)
    first, portions, cores = max(ledger.committed(), default=-1) + 1, -(-(seen.get["rows"] or 0) // portion), spark.sparkContext.defaultParallelism
    most = max(1, min(16, portions, 16 * cores * batch // portion))
    held = left.drop("_portion").schema
    tasks = min(-(-portion // batch), _tasks(work) if most == 1 else -(-2 * cores // most))

    def written(i: int) -> str:
        rows = spark.read.schema(held).parquet(f"{parts}/_portion={i}")
        # a portion's rows lie in few parts: whole batches of neighbours are dealt to the tasks in turn
        turn = F.floor((F.col("_pos") - 1) % portion / batch) % tasks
        rows = rows.repartitionById(tasks, turn.cast("int")).sortWithinPartitions("_pos").drop("_pos")
        return ledger.write(enriched(rows, fn, schema, batch).hint("rebalance", *keys))  # few files, by their size

    with ThreadPoolExecutor(most) as pool:
        for i, name in enumerate(_ahead(pool, inheritable_thread_target(spark)(written), range(portions), most)):
            ledger.commit(first + i, name)
    return ledger.read(made).drop("batch")


def _ahead(pool: ThreadPoolExecutor, fn: Callable, items: Iterable, most: int) -> Iterator:
    """fn of each item, in their order; at most so many are in work or waiting to be taken."""
    made = deque()
    for item in items:
        made.append(pool.submit(fn, item))
        if len(made) == most:
            yield made.popleft().result()
    yield from (f.result() for f in made)


def newer(versions: DataFrame, processed: DataFrame) -> DataFrame:
    """(film_id, version) that haven't been processed."""
    return versions.join(processed, ["film_id", "version"], "left_anti")


def unmeasured(shots: DataFrame, measured: Column) -> DataFrame:
    """(film_id, measured, total) of films where the pass is due, as not all shots have been measured."""
    return shots.groupBy("film_id").agg(F.count_if(measured).alias("measured"), F.count("*").alias("total")).where("measured < total")
