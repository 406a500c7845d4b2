"""A function applied to records whose failures are rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_records(records: DataFrame, index: str, value: str, f: Callable, result: str, seconds: float | None = None, in_flight: int = 4) -> DataFrame:
    """(index, result, error) for every record, in the order of its partition.

    ``f(value)`` runs in at most ``in_flight`` threads of a task.  An exception, or a result
    that is not there ``seconds`` after its turn has come, gives a null result and an error
    text, and the rest goes on; the thread of a late call is left to end by itself.  Memory
    holds one batch and ``in_flight`` results."""
    kind = records.schema[index].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(in_flight)
        late = 0
        for batch in batches:
            out, waiting = [], deque()

            def take() -> None:
                nonlocal pool, late
                k, job = waiting.popleft()
                try:
                    out.append((k, job.result(seconds), None))
                except TimeoutError as e:
                    late += not job.done()
                    out.append((k, None, str(e) or f"TimeoutError: no result after {seconds} s"))
                    if late >= in_flight:  # every thread is held by a late call
                        pool.shutdown(wait=False, cancel_futures=False)
                        pool, late = ThreadPoolExecutor(in_flight), 0
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, f"{type(e).__name__}: {e}"))

            for k, v in zip(batch["_k"], batch["_v"]):
                waiting.append((k, pool.submit(f, v)))
                if len(waiting) >= in_flight:
                    take()
            while waiting:
                take()
            yield pd.DataFrame(out, columns=[index, "result", "error"])
        pool.shutdown(wait=False)

    pairs = records.select(F.col(index).alias("_k"), F.col(value).alias("_v"))
    return pairs.mapInPandas(run, f"`{index}` {kind}, result {result}, error string")
