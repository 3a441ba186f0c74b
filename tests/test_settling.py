"""Streams of archives that are still being copied."""

from __future__ import annotations

import threading
import time

from builders import book, write_zip

from shelfmark.plans import ingest
from shelfmark.streaming.watch import watch_library


def until(condition, seconds=150):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(1)
    return False


def test_an_archive_is_read_when_its_copy_is_finished(catalog, library, tmp_path, monkeypatch):
    write_zip(tmp_path / "whole.zip", {f"{i}.fb2": book(f"Book {i}", "Ann", "Lee") for i in range(1, 30)})
    raw = (tmp_path / "whole.zip").read_bytes()
    write_zip(library / "ready.zip", {"90.fb2": book("Ready")})
    (library / "slow.zip").write_bytes(raw[:500])

    def copy():
        for part in range(600, 600 + 12 * 100, 100):
            time.sleep(1.5)
            (library / "slow.zip").write_bytes(raw[:part])
        (library / "slow.zip").write_bytes(raw)

    copying = threading.Thread(target=copy)
    # The storage fails on the first run that holds an archive; it is offered again.
    failed = []
    outcomes = ingest.outcomes

    def once(todo, parsed, known):
        from pyspark.sql import functions as F

        found = outcomes(todo, parsed, known)
        if failed:
            return found
        failed.extend(r.name for r in todo.collect())
        return found.withColumn("io_failed", F.lit(True))

    monkeypatch.setattr(ingest, "outcomes", once)
    stream = watch_library(catalog, str(tmp_path / "checkpoint"), continuous=True, build_index=False, every="1 second", settle_seconds=6)
    copying.start()
    try:
        assert until(lambda: catalog.count() == 30 or stream.exception())
        assert stream.exception() is None
    finally:
        stream.stop()
        copying.join()
    # While it grew it was not offered, so nothing was read of it.
    assert "slow.zip" not in failed
    assert {(r.name, r.status) for r in catalog.archive_table().collect()} == {("ready.zip", "indexed"), ("slow.zip", "indexed")}
    assert catalog.log().filter("entry is null and level = 'warn'").count() == 0
