"""Repeated indexing of the saved selections: the interval starts when a run has ended, runs never overlap."""

from __future__ import annotations

import time
from collections.abc import Callable


def watch(run: Callable[[], dict], interval_s: float = 30.0, rounds: int | None = None, report: Callable[[dict], None] = print, sleep=time.sleep) -> int:
    """Calls run() again and again; an error is reported and the loop goes on. 130 after an interrupt."""
    done = 0
    try:
        while rounds is None or done < rounds:
            try:
                report({"ok": True, **run()})
            except Exception as e:
                report({"ok": False, "code": getattr(e, "code", type(e).__name__), "detail": str(e)[:200]})
            done += 1
            if rounds is None or done < rounds:
                sleep(interval_s)
    except KeyboardInterrupt:
        return 130
    return 0


def stream(engine, path: str, checkpoint: str, interval: str = "30 seconds"):
    """The same on Structured Streaming: arrivals below a path trigger a full snapshot run, since a file stream
    never reports removals."""
    files = engine.spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path").writeStream.foreachBatch(lambda df, n: engine.index(path)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
