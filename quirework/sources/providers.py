"""Boundaries to external providers (ids A5, A8-A11, A19, N7): a column of inputs to a column of checked answers.

The engine holds no PDF parser, rasterizer, layout model or text recogniser. A provider is a
function of bytes to bytes that runs on the executors - a call over HTTP, a process - behind
limits on time and on the size of both sides. What it does wrong is a status of its row, never
a failed job: Completed, InputTooLarge, OutputTooLarge, TimedOut, Failed.
"""

from __future__ import annotations

import base64
import json
import subprocess
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TimedOut
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[bytes], bytes]


@dataclass(frozen=True)
class Limits:
    """Fixed values of the layout and recognition services."""

    seconds: float = 60.0
    most_in: int = 32 << 20
    most_out: int = 16 << 20


@dataclass(frozen=True)
class Options:
    """What a host is given: the engine's version, services by role, limits, callbacks for assets."""

    engine_version: str = "0"
    endpoints: dict[str, str] = field(default_factory=dict)
    limits: Limits = field(default_factory=Limits)
    rasterizer: str = "pdftoppm"
    dpi: int = 300

    def identities(self) -> list[tuple[str, str]]:
        """Role and identity of each component, for manifests."""
        return sorted(({"engine": self.engine_version, "rasterizer": f"{self.rasterizer}@{self.dpi}"} | self.endpoints).items())


def call(provider: Provider, content: bytes, limits: Limits, pool: ThreadPoolExecutor) -> tuple[str, bytes | None, str | None]:
    """Status, answer and error of one call."""
    if len(content) > limits.most_in:
        return "InputTooLarge", None, f"{len(content)} bytes"
    work = pool.submit(provider, content)
    try:
        answer = work.result(timeout=limits.seconds)
    except TimedOut:
        work.cancel()
        return "TimedOut", None, f"after {limits.seconds:g} s"
    except Exception as x:  # whatever a provider raises is its row's failure
        return "Failed", None, f"{type(x).__name__}: {x}"[:500]
    if len(answer) > limits.most_out:
        return "OutputTooLarge", None, f"{len(answer)} bytes"
    return "Completed", answer, None


def ask(df: DataFrame, content: str, provider: Provider, limits: Limits | None = None) -> DataFrame:
    """All other columns of df, and provider_status, answer and provider_error.

    A null input is an empty one. Each task has one call under way; a call that doesn't end
    holds a thread, not the task.
    """
    limits = limits or Limits()
    kept = [f for f in df.schema.fields if f.name != content]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(max_workers=8)
        try:
            for batch in batches:
                found = [call(provider, bytes(x) if x is not None else b"", limits, pool) for x in batch[content]]
                out = batch.drop(columns=[content])
                for i, name in enumerate(("provider_status", "answer", "provider_error")):
                    out[name] = pd.Series([f[i] for f in found], index=out.index, dtype="object")
                yield out
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "provider_status string, answer binary, provider_error string"])
    return df.mapInPandas(run, schema)


def http_provider(url: str, limits: Limits | None = None) -> Provider:
    """Posts the bytes as a base64 file in JSON and returns the answer's body."""
    limits = limits or Limits()

    def provider(content: bytes) -> bytes:
        body = json.dumps({"file": base64.b64encode(content).decode(), "fileType": 1}).encode()
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=limits.seconds) as answer:
            return answer.read(limits.most_out + 1)

    return provider


def process_provider(command: list[str], limits: Limits | None = None) -> Provider:
    """A process that reads the bytes and writes its answer; another exit code than 0 is a failure."""
    limits = limits or Limits()

    def provider(content: bytes) -> bytes:
        done = subprocess.run(command, input=content, capture_output=True, timeout=limits.seconds, check=False)
        if done.returncode:
            raise RuntimeError(f"exit code {done.returncode}: {done.stderr[-200:].decode(errors='replace')}")
        return done.stdout

    return provider


def raster_command(options: Options, page: int, crop: tuple[int, int, int, int] | None = None) -> list[str]:
    """The rasterizer's call for a page, or for a crop (left, top, right, bottom) of it in pixels."""
    out = [options.rasterizer, "-f", str(page), "-l", str(page), "-singlefile", "-r", str(options.dpi)]
    if crop:
        left, top, right, bottom = crop
        out += ["-x", str(left), "-y", str(top), "-W", str(right - left), "-H", str(bottom - top)]
    return [*out, "-png", "-", "-"]


def single_layout(answers: DataFrame) -> DataFrame:
    """A10: layout_json of answers with exactly one result; other completed answers become Failed."""
    one = F.from_json(F.col("answer").cast("string"), "struct<result:struct<layoutParsingResults:array<struct<prunedResult:string>>>>")
    results = one["result"]["layoutParsingResults"]
    good = (F.col("provider_status") == "Completed") & (F.coalesce(F.size(results), F.lit(-1)) == 1)
    wrong = (F.col("provider_status") == "Completed") & ~F.coalesce(good, F.lit(False))
    out = answers.withColumn("layout_json", F.when(good, F.get_json_object(F.col("answer").cast("string"), "$.result.layoutParsingResults[0].prunedResult")))
    return out.withColumns({"provider_error": F.when(wrong, F.lit("not one layout result")).otherwise(F.col("provider_error")), "provider_status": F.when(wrong, F.lit("Failed")).otherwise(F.col("provider_status"))})


def conformance_outcome(exit_code: Column, errors: Column, fatals: Column) -> Column:
    """Of a conformance check's report: Conformant, NonConformant, or Failed if the check itself didn't end."""
    return F.when(exit_code.isNull() | ~exit_code.isin(0, 1), "Failed").when((errors > 0) | (fatals > 0), "NonConformant").otherwise("Conformant")


def dispatch(events: DataFrame, capacity: int) -> DataFrame:
    """Outcomes of submissions to bounded queues that never wait: Enqueued, QueueFull or Stopped.

    events: queue, at (their order), event (submit, take, stop). One pass over a queue's events;
    what is queued can still be taken after a stop, and a take of an empty queue is Empty.
    """
    if capacity < 1:
        raise ValueError("a queue holds one job at least")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        held, stopped, outcomes, lengths = 0, False, [], []
        for event in rows["event"]:
            if event == "submit":
                outcome = "Stopped" if stopped else "QueueFull" if held >= capacity else "Enqueued"
            elif event == "take":
                outcome = "Taken" if held else "Empty"
            else:
                outcome, stopped = "Stopping", True
            held += {"Enqueued": 1, "Taken": -1}.get(outcome, 0)
            outcomes.append(outcome)
            lengths.append(held)
        return rows.assign(outcome=outcomes, held=lengths)

    return events.select("queue", "at", "event").groupBy("queue").applyInPandas(run, "queue long, at long, event string, outcome string, held long")
