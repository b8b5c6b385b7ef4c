"""Running a stream over what is available now."""

from __future__ import annotations

import time

from pyspark.sql.streaming import StreamingQuery


def run_until_idle(query: StreamingQuery, timeout_s: float | None = None, empty_batches: int = 2) -> None:
    """Wait for a query to end by itself, or stop it once its input is used up; without limit unless one is given.

    State that expires in processing time keeps a query busy with empty micro-batches, so such a
    query neither ends under an `availableNow` trigger nor ever counts as fully processed. One
    empty micro-batch may be the repetition of an unfinished one; the next one has looked at the
    sources again, so two in a row mean there is nothing left. With a new checkpoint one is enough.
    """
    deadline = None if timeout_s is None else time.monotonic() + timeout_s
    try:
        while query.isActive:
            last = query.recentProgress[-empty_batches:]
            if len(last) == empty_batches and not any(p["numInputRows"] for p in last):
                return
            if deadline is not None and time.monotonic() > deadline:
                raise TimeoutError(f"stream still busy after {timeout_s} s")
            time.sleep(0.05)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
