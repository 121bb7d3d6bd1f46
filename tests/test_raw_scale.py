"""raw_methods: the events are made once (F10)."""

from ledgerspark.operators import raw_audit
from ledgerspark.plans import raw

DATA = "/root/testdata/sf0.001"


def test_events_are_read_once(spark, monkeypatch):
    read, stored = [], raw_audit.stored
    monkeypatch.setattr(raw_audit, "stored", lambda df: read.extend(df.inputFiles()) or stored(df))
    assert raw.QUERIES["raw_methods"](spark, DATA).count() == 8
    assert read and not [f for f in read if "events.parquet" in f]
