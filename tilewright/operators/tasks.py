"""Calls to other services: bounded, retried, and isolated per item."""

from __future__ import annotations

import heapq
import json
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.sources.graymaps import located
from tilewright.sources.scratch import fresh_folder

#: The answer that is tried again, and the text of a timeout.
RETRY_STATUS, RETRY_TEXT, TIMEOUT = 500, "Internal Server Error", "Timeout"
MOST = 10
#: Seconds until a quality-control request, a heat-map request and a report request are given up.
QC_SECONDS, HEATMAP_SECONDS, REPORT_SECONDS = 36_000.0, 3_000.0, 3_600.0


def retryable(status: Column, text: Column) -> Column:
    return (status == RETRY_STATUS) & text.contains(RETRY_TEXT)


def timed_out(status: Column, text: Column) -> Column:
    return (status == -1) & (text == TIMEOUT)


def retry_outcomes(attempts: DataFrame, most: int = MOST) -> DataFrame:
    """From a log (wsi_path, attempt, status, text): wsi_path, attempts, status, outcome, backoff_s.

    The first attempt that isn't retryable ends an item; attempt k is followed by 2^k seconds of waiting.
    """
    turn = F.row_number().over(Window.partitionBy("wsi_path").orderBy("attempt"))
    numbered = attempts.withColumn("n", turn).where(F.col("n") <= most).withColumn("again", F.coalesce(retryable(F.col("status"), F.col("text")), F.lit(False)))
    row = F.struct("n", "status", "text")
    ends = numbered.groupBy("wsi_path").agg(F.min(F.when(~F.col("again"), row)).alias("end"), F.max(row).alias("last"))
    end = F.coalesce("end", "last")
    outcome = (
        F.when(F.col("end").isNull() & (F.col("last.n") >= most), "exhausted").when(F.col("end").isNull(), "pending")
        .when(timed_out(end["status"], end["text"]), "timeout").when(end["status"] == -1, "error").otherwise("done")
    )
    waits = end["n"] - F.when(F.col("end").isNull(), 0).otherwise(1)
    return ends.select("wsi_path", end["n"].alias("attempts"), end["status"].alias("status"), outcome.alias("outcome"), (F.pow(F.lit(2), waits + 1) - 2).cast("bigint").alias("backoff_s"))


class Caller:
    """Makes calls one after the other in a thread of its own, which is left to itself and replaced if a call takes too long."""

    def __init__(self, call: Callable[[dict], tuple[int, str]]) -> None:
        self.call, self.given = call, None

    def _run(self, given: queue.SimpleQueue, answers: queue.SimpleQueue) -> None:
        while (item := given.get()) is not None:
            try:
                answers.put(self.call(item))
            except TimeoutError:
                answers.put((-1, TIMEOUT))
            except Exception as error:  # noqa: BLE001  any failure is the item's outcome
                answers.put((-1, str(error)))

    def within(self, item: dict, seconds: float | None) -> tuple[int, str]:
        """(status, text) of one call; one that takes longer or fails in any way is an answer with status -1."""
        if self.given is None:
            self.given, self.answers = queue.SimpleQueue(), queue.SimpleQueue()
            threading.Thread(target=self._run, args=(self.given, self.answers), daemon=True).start()
        self.given.put(item)
        try:
            return self.answers.get(timeout=seconds)
        except queue.Empty:
            self.close()
            return -1, TIMEOUT

    def close(self) -> None:
        """Lets the thread end after what it is doing."""
        if self.given is not None:
            self.given.put(None)
            self.given = None


def within(call: Callable[[dict], tuple[int, str]], item: dict, seconds: float | None) -> tuple[int, str]:
    """(status, text) of one call, see `Caller`."""
    caller = Caller(call)
    try:
        return caller.within(item, seconds)
    finally:
        caller.close()


def item_outcomes(items: Iterator[dict], call: Callable[[dict], tuple[int, str]], most: int, sleep: Callable[[float], None], timeout: float | None, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple]:
    """(item, wsi_path, status, attempts, outcome, error) of each item. While one waits to be tried again, others are called."""
    waiting: list[tuple[float, int, int, dict]] = []
    turn, more, coming, caller = 0, iter(items), None, Caller(call)
    while True:
        coming = next(more, None) if coming is None else coming
        if waiting and (coming is None or waiting[0][0] <= clock()):
            due, _, attempt, item = heapq.heappop(waiting)
            if (left := due - clock()) > 0:
                sleep(left)
        elif coming is None:
            return caller.close()
        else:
            item, attempt, coming = coming, 1, None
        status, text = caller.within(item, timeout)
        outcome = "timeout" if (status, text) == (-1, TIMEOUT) else "error" if status == -1 else "done"
        if status == RETRY_STATUS and RETRY_TEXT in text:
            if attempt < most:
                turn += 1
                heapq.heappush(waiting, (clock() + 2.0**attempt, turn, attempt + 1, item))
                continue
            outcome = "exhausted"
        yield item, item.get("wsi_path") or "<unknown>", status, attempt, outcome, text if outcome != "done" else None


def outcomes(*args, **how) -> Iterator[tuple]:
    """(wsi_path, status, attempts, outcome, error) of each item, see `item_outcomes`."""
    return (row[1:] for row in item_outcomes(*args, **how))


#: Slides of one report request.
REPORT_PATHS = 10_000
OUTCOME = "wsi_path string, status int, attempts int, outcome string, error string"
#: Outcomes of one file of the log, and seconds until a file is written though it has fewer: what a lost task may have to repeat.
BATCH, FLUSH_SECONDS = 256, 1.0


class OutcomeLog:
    """The outcomes of one task's calls, in files that appear whole: an item is finished when the file that has it does.

    A task of the same partition that starts again finds there what the lost one had finished.
    """

    def __init__(self, folder: str, flush_seconds: float = FLUSH_SECONDS) -> None:
        self.system, self.root = located(folder)
        self.flush_seconds, self.held, self.last = flush_seconds, [], time.monotonic()
        self.system.create_dir(self.root, recursive=True)

    def finished(self) -> set[tuple[int, int]]:
        found = set()
        for info in self.system.get_file_info(fs.FileSelector(self.root)):
            if info.path.endswith(".json"):
                with self.system.open_input_stream(info.path) as lines:
                    found |= {(r["item"], r["turn"]) for r in map(json.loads, lines.read().splitlines())}
        return found

    def add(self, row: dict) -> None:
        self.held.append(json.dumps(row))
        if len(self.held) >= BATCH or time.monotonic() - self.last >= self.flush_seconds:
            self.flush()

    def flush(self) -> None:
        if self.held:
            name = f"{self.root}/{uuid.uuid4().hex}"
            with self.system.open_output_stream(f"{name}.part") as out:
                out.write("\n".join(self.held).encode())
            self.system.move(f"{name}.part", f"{name}.json")
            self.held = []
        self.last = time.monotonic()


def logged_outcomes(items: Iterator[dict], log: OutcomeLog, call: Callable[[dict], tuple[int, str]], most: int, sleep: Callable[[float], None], timeout: float | None) -> Iterator[tuple]:
    """(item, turn) of each outcome that is added to the log; items that it has already aren't called."""
    done = log.finished()
    todo = (i for i in items if (i["_item"], i["_turn"]) not in done)
    own = lambda i: {k: v for k, v in i.items() if k not in ("_item", "_turn")}
    for item, path, status, attempts, outcome, error in item_outcomes(todo, lambda i: call(own(i)), most, sleep, timeout):
        log.add({"item": item["_item"], "turn": item["_turn"], "wsi_path": path, "status": status, "attempts": attempts, "outcome": outcome, "error": error})
        yield item["_item"], item["_turn"]
    log.flush()


def call_all(items: DataFrame, call: Callable[[dict], tuple[int, str]], limit: int, most: int = MOST, sleep: Callable[[float], None] = time.sleep, timeout: float | None = QC_SECONDS, log: str | None = None, flush_seconds: float = FLUSH_SECONDS) -> DataFrame:
    """wsi_path, status, attempts, outcome, error: `call` for each row, at most `limit` at a time; a failing item doesn't end the others.

    Outcomes go to a log as they come, below `log` or a new folder of the shared one, and what is returned reads it. Rows that the log has are not called
    again: neither by a task that repeats a lost one nor by a later call with the same `log`; only what was in flight, or finished within the last
    `flush_seconds`, is. Rows are told apart by a hash of all columns and, of equal ones, by their number. Attempt k of a retryable answer is followed by 2^k seconds
    in which the slot serves other items, the last one by none. `call` returns (status, text) and must be safe to repeat.
    """
    spark = items.sparkSession
    folder = log or fresh_folder(spark, "calls")
    numbered = items.withColumn("_item", F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))
    numbered = numbered.withColumn("_turn", F.row_number().over(Window.partitionBy("_item").orderBy(F.lit(0))))
    known = _log_rows(spark, folder)
    todo = numbered if known is None else numbered.join(known.select(F.col("item").alias("_item"), F.col("turn").alias("_turn")), ["_item", "_turn"], "left_anti")
    job = f"{folder}/{uuid.uuid4().hex}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (item for frame in frames for item in frame.to_dict("records"))
        ended = logged_outcomes(rows, OutcomeLog(f"{job}/{TaskContext.get().partitionId()}", flush_seconds), call, most, sleep, timeout)
        yield pd.DataFrame({"n": [sum(1 for _ in ended)]})  # the outcomes are in the log

    todo.repartition(limit, "_item", "_turn").mapInPandas(run, "n bigint").write.format("noop").mode("overwrite").save()
    found = _log_rows(spark, folder)
    if found is None:
        return spark.createDataFrame([], OUTCOME)
    mine = numbered.select(F.col("_item").alias("item"), F.col("_turn").alias("turn"))  # a log may have rows of other items too
    return (found if log is None else found.join(mine, ["item", "turn"], "left_semi")).select("wsi_path", "status", "attempts", "outcome", "error")


def _log_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of a log; None if it has none yet. An outcome that two tasks logged counts once."""
    system, root = located(folder)
    listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    if not any(i.path.endswith(".json") for i in listed):
        return None
    return spark.read.schema(f"item bigint, turn bigint, {OUTCOME}").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).dropDuplicates(["item", "turn"])


def qc_payload(path: Column, output_path: str, mask_level: int, sample_level: int, residual: bool = True, folding: bool = True, blur: bool = True) -> Column:
    return F.to_json(F.struct(path.alias("wsi_path"), F.lit(output_path).alias("output_path"), F.lit(mask_level).alias("mask_level"), F.lit(sample_level).alias("sample_level"), F.lit(residual).alias("check_residual"), F.lit(folding).alias("check_folding"), F.lit(blur).alias("check_blur")))


def report_requests(paths: DataFrame, url: str, mask_dir: str, save_location: str, part: Column | None = None, metrics: bool = True, most_paths: int = REPORT_PATHS) -> DataFrame:
    """(url, payload) of the report requests: one for each value of `part`, by default as few as keep some `most_paths` slides in each, which is one for small tables."""
    if part is None:
        parts = -(-paths.count() // most_paths)
        part = F.pmod(F.xxhash64("wsi_path"), F.lit(max(parts, 1)))
    body = F.struct(F.array_sort(F.collect_list("wsi_path")).alias("backgrounds"), F.lit(mask_dir).alias("mask_dir"), F.lit(save_location).alias("save_location"), F.lit(metrics).alias("compute_metrics"))
    return paths.withColumn("part", part).groupBy("part").agg(F.to_json(body).alias("payload")).select(F.lit(url + "report").alias("url"), "payload")
