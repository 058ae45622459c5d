"""Assembly as a stream: chunks of predictions come in any order, whole subjects go out once they are complete."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK_SCHEMA = "subject int, sample_index long, arrival long, z int, n_slices int, data array<double>"
OUT_SCHEMA = "subject int, z int, data array<double>"
STATE_SCHEMA = "zs array<int>, arrivals array<long>, flat array<double>"


def assemble_stream(chunks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Slices of complete subjects. A chunk is a slice z of a volume of ``n_slices``; a slice that comes again with a
    later arrival replaces the one held. State is one volume for each open subject; with a timeout, subjects that stay
    incomplete so long are dropped."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[int, tuple[int, Any]] = {}
        if state.exists:
            zs, arrivals, flat = state.get
            rows = np.array(flat, float).reshape(len(zs), -1)
            held = {int(z): (int(a), r) for z, a, r in zip(zs, arrivals, rows, strict=True)}
        want = 0
        for frame in frames:
            for row in frame.itertuples():
                want = int(row.n_slices)
                if row.z not in held or row.arrival >= held[row.z][0]:
                    held[int(row.z)] = (int(row.arrival), np.asarray(row.data, float))
        if len(held) >= want > 0:
            state.remove()
            order = sorted(held)
            yield pd.DataFrame({"subject": key[0], "z": order, "data": [held[z][1].tolist() for z in order]})
            return
        order = sorted(held)
        state.update((order, [held[z][0] for z in order], np.concatenate([held[z][1] for z in order]).tolist()))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("subject").applyInPandasWithState(fold, OUT_SCHEMA, STATE_SCHEMA, "append", kind)
