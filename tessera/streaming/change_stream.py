"""The change log over a stream: an extension, as what is matched reads finite input only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expressions import PAL_CYCLES

LOG = "chip long, reg string, clock long, val long"


def change_stream(states: DataFrame, cycles: int = PAL_CYCLES) -> DataFrame:
    """Changes of a stream of states (chip, reg string, frame, val): per chip and register the
    state is the last value. Frames of a micro-batch are put in order; later ones must not be earlier."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("frame", kind="stable")
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        out = []
        for frame, val in zip(rows["frame"].tolist(), rows["val"].tolist(), strict=True):
            if not seen or val != last:
                out.append((key[0], key[1], int(frame * cycles), val))
            seen, last = True, val
        state.update((last,))
        yield pd.DataFrame(out, columns=["chip", "reg", "clock", "val"])

    return states.groupBy("chip", "reg").applyInPandasWithState(each, LOG, "val long", "append", GroupStateTimeout.NoTimeout)
