"""Cars that share an id are told apart by following each of them from frame to frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metres that a car moves at most from one of its rows to the next; and the cost of a match beyond that.
REACH = 5.0
BEYOND = 1e9


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the smaller side has: shortest augmenting paths with potentials."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    price_row, price_col, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        best, came, done, at = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool), m
        owner[m] = i
        while owner[at] >= 0:
            done[at] = True
            row = owner[at]
            open_ = np.flatnonzero(~done[:m])
            reduced = cost[row, open_] - price_row[row] - price_col[open_]
            better = reduced < best[open_]
            best[open_[better]], came[open_[better]] = reduced[better], at
            to = open_[np.argmin(best[open_])]
            step = best[to]
            used = np.flatnonzero(done)
            price_row[owner[used]] += step
            price_col[used] -= step
            best[open_] -= step
            at = to
        while at != m:
            owner[at], at = owner[came[at]], came[at]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def follow(x: np.ndarray, y: np.ndarray, frame: np.ndarray, reach: float = REACH) -> np.ndarray:
    """The number of the car of each row of one id, in the order in which cars are first seen; rows are in the order of frames."""
    car, last = np.zeros(len(x), int), np.zeros((0, 2))
    for f in np.unique(frame):
        at = np.flatnonzero(frame == f)
        here = np.stack([x[at], y[at]], 1)
        taken = set()
        if len(last):
            far = np.hypot(*(last[:, None, :] - here[None, :, :]).transpose(2, 0, 1))
            cost = np.where(far <= reach, far, BEYOND)
            for i, j in assign(cost):
                if cost[i, j] < BEYOND:
                    car[at[j]], last[i] = i, here[j]
                    taken.add(j)
        for j in range(len(at)):
            if j not in taken:
                car[at[j]] = len(last)
                last = np.vstack([last, here[j]])
    return car


def split_shared_ids(tracks: DataFrame, reach: float = REACH) -> DataFrame:
    """carId, as text, with _0, _1 and so on where several cars of a scene share it; ids without repeated frames stay as they are.

    Only ids with a frame that they have twice are followed, each in one task; their number of rows is that of a few cars.
    """
    columns = tracks.columns
    rows = tracks.withColumn("carId", F.col("carId").cast("string"))
    shared = rows.groupBy("scene_id", "carId", "frameNum").count().where("count > 1").select("scene_id", "carId").distinct()
    clean = rows.join(shared, ["scene_id", "carId"], "left_anti").select(*columns)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frameNum", "carCenterXm", "carCenterYm"], kind="stable").reset_index(drop=True)
        car = follow(part["carCenterXm"].to_numpy(float), part["carCenterYm"].to_numpy(float), part["frameNum"].to_numpy(), reach)
        part["carId"] = [f"{c}_{k}" for c, k in zip(part["carId"], car, strict=True)]
        return part[columns]

    mixed = rows.join(shared, ["scene_id", "carId"], "left_semi").select(*columns)
    return clean.unionByName(mixed.groupBy("scene_id", "carId").applyInPandas(one, mixed.schema))
