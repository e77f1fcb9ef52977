"""Vital signs of running captures: each micro-batch brings frames, the state keeps the last window of each capture."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sweepframe.operators.temporal import FPS, VITALS, vitals_of


def trailing_vitals(series: DataFrame, fps: float = FPS) -> DataFrame:
    """(capture_id string, frame int, signal double) as a stream -> the vital signs of the last max(16, round(5 fps)) frames of every capture that got frames.

    Frames may come late or twice within the window: the state is ordered by
    frame and keeps one signal for each. Fewer than 4 frames give no row.
    """
    size = max(16, round(5.0 * fps))
    columns = ["capture_id", "frame", *[c.split()[0] for c in VITALS.split(", ")]]

    def update(key, batches, state):
        frames, signals = state.get if state.exists else ([], [])
        held = dict(zip(frames, signals))
        for batch in batches:
            held.update(zip(batch["frame"].tolist(), batch["signal"].tolist()))
        last = sorted(held)[-size:]
        state.update((last, [held[f] for f in last]))
        if len(last) >= 4:
            yield pd.DataFrame([(key[0], last[-1], *vitals_of(np.array([held[f] for f in last]), fps))], columns=columns)

    return series.groupBy("capture_id").applyInPandasWithState(update, f"capture_id string, frame int, {VITALS}", "frames array<int>, signals array<double>", "update", "NoTimeout")
