from datetime import datetime, timedelta

from relayloom.schema import ENVELOPES
from relayloom.testing import RecordingHook, memory_stack

T0 = datetime(2024, 1, 10, 12)


def test_a_stack_in_memory(spark):
    hook = RecordingHook()
    s = memory_stack(spark, hooks=[hook])
    s.listener("made")(lambda e: None)
    base = dict.fromkeys(ENVELOPES.names) | {"event_type": "made", "payload_json": "{}", "occurred_at": T0}
    s.write(spark.createDataFrame([tuple((base | {"event_id": i}).values()) for i in "ab"], ENVELOPES), T0)
    assert hook.calls == [(what, ["a", "b"]) for what in ("before_write", "after_write", "after_commit")]
    assert s.cycle(T0 + timedelta(minutes=1)) == 2
    assert {r.status for r in s.store.read().collect()} == {1} and s.exporter.counters["dispatch_success"] == 2
