"""The sequential ingest rule, record after record, as a stream with state and as a fold over a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight import model

_OUT = "tenant_id long, event_id long, arrival long, status string"
#: Event ids that a fence remembers, the last ones.
REMEMBERED = 131_072


def decide(rows: pd.DataFrame, fence: int, seen: dict) -> tuple[list[str], int]:
    """Statuses in order of arrival. A stale record isn't remembered; a duplicate doesn't raise the fence."""
    out = []
    for event, epoch, generation, flags in zip(rows["event_id"].tolist(), rows["epoch"].tolist(), rows["generation"].tolist(), rows["flags"].tolist()):
        if epoch > model.LARGEST_VERSION or generation > model.LARGEST_VERSION:
            out.append("CORRUPT")
        elif epoch < fence:
            out.append("STALE_FENCING_EPOCH")
        elif event in seen and str(event) != model.NIL_ID:
            out.append("DUPLICATE")
        else:
            fence = max(fence, epoch)
            seen[event] = None
            if len(seen) > REMEMBERED:
                del seen[next(iter(seen))]
            out.append("TOMBSTONE_APPLIED" if flags & model.TOMBSTONE else "OK")
    return out, fence


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fence, events = state.get if state.exists else (0, [])
    seen = dict.fromkeys(events)
    rows = pd.concat(list(batches)).sort_values("arrival")
    statuses, fence = decide(rows, fence, seen)
    state.update((fence, list(seen)))
    yield pd.DataFrame({"tenant_id": key[0], "event_id": rows["event_id"], "arrival": rows["arrival"], "status": statuses})


def ingest(records: DataFrame) -> DataFrame:
    """tenant_id, event_id, arrival, status of a stream, with a fence and a memory of ids for each tenant."""
    return records.select("tenant_id", "event_id", "arrival", "epoch", "generation", "flags").groupBy("tenant_id").applyInPandasWithState(_fold, _OUT, "fence long, events array<long>", "append", GroupStateTimeout.NoTimeout)


def latest(records: DataFrame) -> DataFrame:
    """The current version of each object, kept up to date (output mode update)."""
    from quarrylight.operators.identity import latest as batch

    return batch(records)


def sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to its own folder, so that a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
