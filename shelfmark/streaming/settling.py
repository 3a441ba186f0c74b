"""Archives are offered once their copy is finished, and again while a fault may have kept them out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.sources import archives as arc

OFFERED = "name string, path string, length long, modified timestamp"
_SEEN = "length long, modified_ns long, offers int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def measured(path: str) -> tuple[int, int] | None:
    """Length and time of a file as its storage tells them, NULL if it is gone."""
    from pyarrow import fs

    system, name = arc.located(path)
    info = system.get_file_info(name)
    return None if info.type != fs.FileType.File else (info.size, int(info.mtime_ns or 0))


class Settling(StatefulProcessor):
    """State and timers for each archive file.

    A file is looked at again `settle_ms` after its last change; if length and
    time are the same it is offered. It is offered `offers` times, each after
    twice the wait of the one before: whoever takes it leaves out what is
    indexed, so a later offer matters only after a fault. Then it is forgotten.
    """

    def __init__(self, settle_ms: int, offers: int):
        self.settle_ms, self.offers = settle_ms, offers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _SEEN)

    def _look(self, path: str, now: int, offers: int) -> tuple[int, int] | None:
        found = measured(path)
        if found is None:
            self.seen.clear()
        else:
            self.seen.update((*found, offers))
            self.handle.registerTimer(now + self.settle_ms * 2**offers)
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for _ in rows:
            pass
        if not self.seen.exists():
            self._look(key[0], timerValues.getCurrentProcessingTimeInMs(), 0)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        path, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        if not self.seen.exists():
            return
        length, modified_ns, offers = self.seen.get()
        found = measured(path)
        if found is None:
            self.seen.clear()
        elif found != (length, modified_ns):
            self._look(path, now, 0)
        else:
            if offers + 1 < self.offers:
                self._look(path, now, offers + 1)
            else:
                self.seen.clear()
            yield pd.DataFrame({"name": [path.rsplit("/", 1)[-1]], "path": [path], "length": [length], "modified": [pd.Timestamp(modified_ns // 1000 * 1000)]})

    def close(self) -> None:
        pass


def settled(found: DataFrame, settle_seconds: float, offers: int) -> DataFrame:
    """A stream of files (path, …) as a stream of archives whose copies are finished."""
    found.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    processor = Settling(int(settle_seconds * 1000), offers)
    return found.groupBy("path").transformWithStateInPandas(processor, OFFERED, "append", "processingTime")
