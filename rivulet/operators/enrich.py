"""The typed ride-request job: filter, re-key, sample, enrich, apply the response."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, wait
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rivulet.functions.fare import GATEWAY_TIMEOUT, OK_STATUS, fare, fare_status

# One in twenty requests is priced, with at most 20 calls in flight for 30 s each.
SAMPLE_EVERY = 20
IN_FLIGHT = 20
CALL_TIMEOUT_S = 30

SERVER_ERROR = 500
# Overdue calls that may still be running in a task.
MOST_HUNG = 200
# Rows, and seconds, after which answered rows are handed on.
HANDED_ON, HAND_ON_S = 1000, 1.0

Client = Callable[[str | None], tuple[int, str]]


def only_type(df: DataFrame, kind: Column, wanted: str) -> DataFrame:
    return df.where(kind == wanted)


def with_request_id(df: DataFrame) -> DataFrame:
    """The request id becomes the older trip id, which is then cleared.

    Rows without a trip id have nothing to be priced by: they are marked, for the error route.
    """
    missing = F.when(F.col("trip_id").isNull(), "trip_id")
    marked = F.coalesce("error_type", missing) if "error_type" in df.columns else missing
    return df.withColumns({
        "error_type": marked,
        "ride_request_id": F.col("trip_id"),
        "trip_id": F.lit(None).cast("bigint"),
    })


def sample_mod(df: DataFrame, column: str, n: int = SAMPLE_EVERY) -> DataFrame:
    """Keep the rows whose id is a multiple of ``n``: the same rows on every run. Rows marked as errors
    are no requests to sample from; they all stay."""
    wanted = F.col(column) % n == 0
    return df.where(wanted | F.col("error_type").isNotNull() if "error_type" in df.columns else wanted)


def price_natively(df: DataFrame, ride_id: str = "ride_request_id") -> DataFrame:
    """What ``enrich`` and ``apply_response`` give for the fare model, inside the plan: no Python
    process, no call, no text to build and parse."""
    answered = fare_status(F.col(ride_id)) == OK_STATUS
    if "error_type" in df.columns:
        answered = answered | F.col("error_type").isNotNull()
    return df.where(answered).withColumn("expected_fare", fare(F.col(ride_id)))


def _answer(future: Future) -> tuple[int, str | None]:
    try:
        return future.result()
    except Exception as problem:
        return SERVER_ERROR, str(problem)


def _started(client: Client, request) -> Future:
    """The call in a thread of its own, so that calls that never end hold nothing up."""
    future: Future = Future()

    def run() -> None:
        try:
            future.set_result(client(request))
        except BaseException as problem:
            future.set_exception(problem)

    threading.Thread(target=run, daemon=True).start()
    return future


class ServiceDown(RuntimeError):
    """So many calls never ended that the task gives up and leaves its retry to Spark."""


def answers_as_they_come(
    requests: Iterator, client: Client, capacity: int, timeout: float, most_hung: int = MOST_HUNG
) -> Iterator[tuple[int, tuple[int, str | None]]]:
    """(place, answer) of each request, in the order in which the calls end.

    At most ``capacity`` calls are in flight; requests are only read as slots become free, so a slow call
    holds back no other one. An overdue call answers 504 and frees its slot; a raising one answers 500.
    Threads of overdue calls go on until they end; with ``most_hung`` of them alive, ``ServiceDown`` is
    raised: no call is left out, and a dead service does not fill the worker with threads.
    """
    in_flight: dict[Future, tuple[int, float]] = {}
    hung: set[Future] = set()
    waiting, place = True, 0
    while waiting or in_flight:
        while waiting and len(in_flight) < capacity:
            hung = {future for future in hung if not future.done()}
            if len(hung) >= most_hung:
                raise ServiceDown(f"{len(hung)} calls have not ended in {timeout} s and more")
            try:
                request = next(requests)
            except StopIteration:
                waiting = False
                break
            in_flight[_started(client, request)] = (place, time.monotonic() + timeout)
            place += 1
        if not in_flight:
            return
        next_due = min(due for _, due in in_flight.values())
        done, _ = wait(in_flight, max(next_due - time.monotonic(), 0), FIRST_COMPLETED)
        for future in done:
            yield in_flight.pop(future)[0], _answer(future)
        now = time.monotonic()
        for future in [f for f, (_, due) in in_flight.items() if due <= now]:
            hung.add(future)
            yield in_flight.pop(future)[0], (GATEWAY_TIMEOUT, None)


def call_all(
    requests: list, client: Client, capacity: int, timeout: float
) -> list[tuple[int, str | None]]:
    """Answers in request order, from calls that complete in any order; see ``answers_as_they_come``."""
    answers: list = [None] * len(requests)
    for place, answer in answers_as_they_come(iter(requests), client, capacity, timeout):
        answers[place] = answer
    return answers


def enriched_batches(
    batches: Iterator[pa.RecordBatch], client: Client, request: str, capacity: int, timeout: float
) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches with their answers, in the order of the answers.

    Calls overlap over the borders of batches: while one call is slow, rows of later batches are called
    and handed on. A batch is held until its last row is answered; of those that follow, at most the rows
    that are in flight are held, too.
    """
    held: dict[int, pa.RecordBatch] = {}
    left: dict[int, int] = {}
    places: dict[int, tuple[int, int]] = {}
    numbers = count()

    def requests() -> Iterator[str | None]:
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            held[number], left[number] = batch, batch.num_rows
            for row, value in enumerate(batch.column(request).cast(pa.string()).to_pylist()):
                places[next(numbers)] = number, row
                yield value

    def handed_on(ready: list[tuple[int, int, tuple[int, str | None]]]) -> Iterator[pa.RecordBatch]:
        for number in sorted({n for n, _, _ in ready}):
            own = [(row, answer) for n, row, answer in ready if n == number]
            rows = held[number].take(pa.array([row for row, _ in own]))
            left[number] -= len(own)
            if not left[number]:
                del held[number], left[number]
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array([status for _, (status, _) in own], pa.int32()),
                    pa.array([body for _, (_, body) in own], pa.string()),
                ],
                names=[*rows.schema.names, "status", "body"],
            )

    ready: list[tuple[int, int, tuple[int, str | None]]] = []
    since = time.monotonic()
    for place, answer in answers_as_they_come(requests(), client, capacity, timeout):
        ready.append((*places.pop(place), answer))
        if len(ready) >= HANDED_ON or time.monotonic() - since > HAND_ON_S:
            yield from handed_on(ready)
            ready, since = [], time.monotonic()
    yield from handed_on(ready)


def enrich(
    df: DataFrame,
    make_client: Callable[[], Client],
    request: str = "ride_request_id",
    capacity: int = IN_FLIGHT,
    timeout: float = CALL_TIMEOUT_S,
) -> DataFrame:
    """Add ``status`` and ``body`` by calling an external service, ``capacity`` calls at a time.

    The client is made once per task; the client gets the request id as text. Rows are handed on as
    their answers come, not in their order. Calls may
    be repeated when a task is retried. Filter and sample before this step: predicates do not move
    across it.
    """
    schema = T.StructType([
        *df.schema.fields, T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return enriched_batches(batches, make_client(), request, capacity, timeout)

    return df.mapInArrow(run, schema)


def apply_response(df: DataFrame) -> DataFrame:
    """Keep answered requests and attach the fare found in the body."""
    amount = F.get_json_object("body", "$.expected_fare").try_cast("double")
    return df.where(F.col("status") == OK_STATUS).withColumn("expected_fare", amount).drop("status", "body")
