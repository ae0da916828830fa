import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rivulet.operators import delivery, packing


def greedy(sizes, max_records, max_bytes):
    """Brute force: one record after the other."""
    numbers, number, held, used = [], 1, 0, 0
    for size in sizes:
        if held + 1 > max_records or used + size > max_bytes:
            number, held, used = number + 1, 0, 0
        held, used = held + 1, used + size
        numbers.append(number)
    return numbers


def records(spark, sizes_by_invocation):
    rows = [(inv, i, s) for inv, sizes in sizes_by_invocation.items() for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "invocation bigint, offset bigint, size bigint").repartition(3)


def packed(df, **limits):
    out = packing.pack_batches(df, "invocation", ["offset"], **limits).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.invocation, r.offset)):
        found.setdefault(r.invocation, []).append(r.batch_no)
    return found


def test_two_records_make_one_batch(spark):
    assert packed(records(spark, {0: [10, 10]})) == {0: [1, 1]}


def test_525_records_make_two_batches(spark):
    df = records(spark, {7: [20] * 525})
    assert packed(df)[7] == [1] * 500 + [2] * 25
    by_count = packing.pack_by_count(df, "invocation", ["offset"])
    assert sorted((r.batch_no, r.records) for r in packing.batch_sizes(by_count).collect()) == [(1, 500), (2, 25)]


@pytest.mark.parametrize("arrow_rows", ["7", "10000"])
def test_pack_matches_brute_force_over_arrow_batches(spark, arrow_rows):
    draw = random.Random(3)
    sizes = {inv: [draw.randint(1, 100) for _ in range(draw.randint(1, 400))] for inv in range(12)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        found = packed(records(spark, sizes), max_records=9, max_bytes=300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {inv: greedy(s, 9, 300) for inv, s in sizes.items()}


def test_batch_may_be_filled_exactly(spark):
    assert packed(records(spark, {0: [50, 50, 100, 1]}), max_bytes=100) == {0: [1, 1, 2, 3]}


def test_oversize_records_take_the_error_route(spark):
    df = records(spark, {0: [10, 101, 20]})
    fits, over = packing.split_oversize(df, 100)
    assert packed(fits, max_bytes=100) == {0: [1, 1]}
    assert [(r.offset, r.error_type) for r in over.collect()] == [(1, "oversize")]
    with pytest.raises(Exception, match="split_oversize"):
        packed(df, max_bytes=100)


@pytest.mark.parametrize("size", [0, 10_001])
def test_invocation_bounds(size):
    with pytest.raises(ValueError):
        packing.invocation_of(F.col("offset"), size)


def failing(first_failures, code=delivery.RETRYABLE):
    """A receiver that fails the first record of its first calls, and counts calls."""
    calls = []

    def client(lines):
        calls.append(list(lines))
        errors = [None] * len(lines)
        if len(calls) <= first_failures:
            errors[0] = code
        return errors

    return client, calls


def test_one_call_when_all_is_delivered():
    client, calls = failing(0)
    assert delivery.put_with_retry(["a", "b"], client) == ([1, 1], [None, None])
    assert len(calls) == 1


def test_retry_sends_only_what_failed():
    client, calls = failing(1)
    assert delivery.put_with_retry(["a", "b"], client, backoff=float) == ([2, 1], [None, None])
    assert calls == [["a", "b"], ["a"]]


def test_gives_up_after_four_calls():
    client, calls = failing(99)
    assert delivery.put_with_retry(["a", "b"], client, backoff=float) == ([4, 1], [delivery.RETRYABLE, None])
    assert len(calls) == 4


def test_other_errors_are_not_retried():
    client, calls = failing(1, "InternalFailure")
    assert delivery.put_with_retry(["a", "b"], client, backoff=float) == ([1, 1], ["InternalFailure", None])
    assert len(calls) == 1


def test_backoff_range():
    assert {delivery.random_backoff() for _ in range(300)} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("fused", [False, True])
def test_deliver_reports_every_record_once(spark, fused):
    lines = spark.range(1300).select(
        (F.col("id") / 600).cast("bigint").alias("invocation"), F.col("id").alias("offset"),
        F.col("id").cast("string").alias("line"), F.lit(10).cast("bigint").alias("size"),
    )

    def make_client():
        sent = set()

        def client(batch):
            assert len(batch) <= 500
            errors = [delivery.RETRYABLE if int(v) % 100 == 0 and v not in sent else None for v in batch]
            sent.update(batch)
            return errors

        return client

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        delivered = delivery.pack_and_deliver(
            lines, make_client, "invocation", ["offset"], ["offset"], backoff=float
        ) if fused else delivery.deliver(
            packing.pack_batches(lines, "invocation", ["offset"]), make_client, ["invocation", "batch_no"],
            ["offset"], backoff=float,
        )
        out = delivered.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.offset for r in out) == list(range(1300))
    assert all(r.attempts == (2 if r.offset % 100 == 0 else 1) and r.status == "delivered" for r in out)
    outcomes = spark.createDataFrame(out, delivered.schema)
    report = delivery.delivery_report(outcomes, ["invocation", "batch_no"]).collect()
    assert sorted((r.invocation, r.batch_no, r.attempted, r.retried, r.lost) for r in report) == [
        (0, 1, 500, 5, 0), (0, 2, 100, 1, 0), (1, 1, 500, 5, 0), (1, 2, 100, 1, 0), (2, 1, 100, 1, 0),
    ]
    assert delivery.undelivered(outcomes).count() == 0


def test_retries_end_with_their_duration():
    now = [0.0]

    def client(lines):
        now[0] += 1
        return [delivery.RETRYABLE] * len(lines)

    attempts, errors = delivery.put_with_retry(
        ["a"], client, retries=None, backoff=float, retry_s=5, clock=lambda: now[0]
    )
    assert (attempts, errors) == ([6], [delivery.RETRYABLE])
    with pytest.raises(ValueError):
        delivery.put_with_retry(["a"], client, retries=None)
    with pytest.raises(ValueError):
        delivery.put_with_retry(["a"], client, retry_s=7201)


@pytest.mark.parametrize("bad", [set(), {0}, {9}, {3, 4}, set(range(10)), {1, 5, 8}])
def test_bisecting_finds_exactly_the_bad_records(bad):
    calls, done = [], []

    def process(lines):
        calls.append(lines)
        for line in lines:
            if int(line) in bad:
                raise ValueError(f"bad {line}")
        done.extend(lines)

    attempts, errors = delivery.process_bisecting([str(k) for k in range(10)], process, retries=2, backoff=float)
    assert {k for k, e in enumerate(errors) if e} == bad
    assert all(errors[k] == f"ValueError: bad {k}" for k in bad)
    assert done == [str(k) for k in range(10) if k not in bad], "records keep their order"
    assert all(a <= 1 + math.ceil(math.log2(10)) + (2 if k in bad else 0) for k, a in enumerate(attempts))
    assert len(calls) <= 1 + len(bad) * (2 * math.ceil(math.log2(10)) + 2)


def test_bisecting_retries_single_records_and_takes_no_records():
    seen = Counter()

    def process(lines):
        seen.update(lines)
        if "flaky" in lines and seen["flaky"] < 5:
            raise OSError("down")

    attempts, errors = delivery.process_bisecting(["a", "flaky", "b"], process, retries=3, backoff=float)
    assert errors == [None] * 3 and attempts[1] == 5
    assert delivery.process_bisecting([], process) == ([], [])
