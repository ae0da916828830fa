import threading
import time

import pyarrow as pa
import pytest

from rivulet.operators import enrich


def test_calls_overlap_up_to_capacity():
    lock, state = threading.Lock(), {"now": 0, "most": 0}

    def client(value):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.01)
        with lock:
            state["now"] -= 1
        return 200, value

    values = [str(i) for i in range(60)]
    assert enrich.call_all(values, client, 20, 30) == [(200, v) for v in values]
    assert 1 < state["most"] <= 20


def test_overdue_call_answers_504_and_frees_its_slot():
    release = threading.Event()

    def client(value):
        if value == "slow":
            release.wait(10)
        if value == "bad":
            raise OSError("no route")
        return 200, value

    answers = enrich.call_all(["slow", "slow", "a", "bad", "b"], client, 2, 0.2)
    release.set()
    assert answers == [(504, None), (504, None), (200, "a"), (500, "no route"), (200, "b")]


def test_hung_calls_hold_nothing_up():
    release = threading.Event()

    def client(value):
        if value.startswith("hung"):
            release.wait(20)
        return 200, value

    requests = [f"hung{k}" for k in range(60)] + [str(k) for k in range(40)]
    answers = enrich.call_all(requests, client, 20, 0.3)
    release.set()
    assert answers == [(504, None)] * 60 + [(200, str(k)) for k in range(40)]


def test_enrich_keeps_rows_whole_and_apply_drops_failures(spark):
    rows = spark.createDataFrame(
        [(2**60 + 1, 1, "x"), (None, None, None), (3, 404, "y")], "big bigint, ride_request_id bigint, note string"
    )

    def make_client():
        def client(ride_id):
            if ride_id is None:
                return 400, "missing"
            return (404, "") if ride_id == "404" else (200, '{"expected_fare": 12.5}')

        return client

    answered = enrich.enrich(rows, make_client)
    assert sorted((r.status, r.big) for r in answered.collect() if r.big) == [(200, 2**60 + 1), (404, 3)]
    kept = enrich.apply_response(answered).collect()
    assert [(r.big, r.note, r.expected_fare) for r in kept] == [(2**60 + 1, "x", 12.5)]


def test_a_slow_call_delays_no_other_row_over_batch_borders():
    release, seen = threading.Event(), []

    def client(value):
        seen.append(value)
        if value == "0":
            release.wait(20)
        return 200, value

    batches = (pa.RecordBatch.from_pydict({"id": list(range(k, k + 10)), "note": ["n"] * 10}) for k in range(0, 2_000, 10))
    out = enrich.enriched_batches(batches, client, "id", 5, 30)
    got = []
    for batch in out:
        got += batch.column("id").to_pylist()
        assert batch.column("body").to_pylist() == [str(i) for i in batch.column("id").to_pylist()]
        if len(got) >= 1_000 and not release.is_set():
            assert 0 not in got, "later rows are handed on while the first one waits"
            release.set()
    assert sorted(got) == list(range(2_000)) and len(seen) == 2_000


def test_no_more_calls_in_flight_than_wanted_over_batches():
    lock, state = threading.Lock(), {"now": 0, "most": 0}

    def client(value):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.002)
        with lock:
            state["now"] -= 1
        return 200, value

    batches = (pa.RecordBatch.from_pydict({"id": [k] * (k % 3)}) for k in range(200))
    batches = (b if b.num_rows else pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64())}) for b in batches)
    total = sum(b.num_rows for b in enrich.enriched_batches(batches, client, "id", 20, 30))
    assert total == sum(k % 3 for k in range(200)) and 1 < state["most"] <= 20


def test_a_dead_service_ends_the_task_instead_of_filling_it_with_threads():
    release, started = threading.Event(), []

    def client(value):
        started.append(value)
        release.wait(20)
        return 200, value

    with pytest.raises(enrich.ServiceDown):
        list(enrich.answers_as_they_come(iter(str(k) for k in range(500)), client, 5, 0.02, most_hung=20))
    release.set()
    assert len(started) <= 25
