"""Audio sequences: windows of shots around candidates, and whole films packed into windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The longest gap between contiguous shots, the aimed and the longest length, rounds to both sides.
GAP, AIM, MOST, ROUNDS = 1.2, 45.0, 90.0, 3


def islands(shots: DataFrame, gap: float = GAP) -> DataFrame:
    """shots with the number of their run of contiguous shots."""
    order = Window.partitionBy("film_id").orderBy("debut", "n")
    new = F.when(F.col("debut") - F.lag("fin").over(order) <= gap, 0).otherwise(1)
    return shots.withColumn("_new", new).withColumn("island", F.sum("_new").over(order)).drop("_new")


class Run:
    """The shots of a film in order. A window is a pair of positions within one run of contiguous shots."""

    def __init__(self, start: np.ndarray, end: np.ndarray, gap: float = GAP, most: float = MOST):
        self.start, self.end, self.most = start, np.maximum(start, end), most
        self.gaps = self.start[1:] - self.end[:-1]
        self.run = np.concatenate(([0], np.cumsum(self.gaps > gap)))

    def seconds(self, window: tuple[int, int]) -> float:
        return self.end[window[1]] - self.start[window[0]]

    def wider(self, window: tuple[int, int], left: bool) -> tuple[int, int] | None:
        """The window with one more shot on a side, if the run goes on there and the length allows it."""
        grown = (window[0] - left, window[1] + (not left))
        inside = 0 <= grown[0] and grown[1] < len(self.start) and self.run[grown[0]] == self.run[grown[1]]
        return grown if inside and self.seconds(grown) <= self.most else None

    def around(self, at: int, aim: float = AIM, rounds: int = ROUNDS) -> tuple[int, int]:
        """Some rounds of one shot to either side, then one shot after the other, across the smaller gap, up to the aim."""
        window = at, at
        for left in (True, False) * rounds:
            window = self.wider(window, left) or window
        while self.seconds(window) < aim:
            ways = [(max(0.0, self.gaps[grown[0] if left else grown[1] - 1]), self.seconds(grown), not left, grown) for left in (True, False) if (grown := self.wider(window, left))]
            if not ways:
                break
            window = min(ways)[-1]
        return window

    def united(self, windows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Windows (first, last, score), those that touch joined while the whole isn't too long."""

        def take(done: list[tuple[int, int, int]], new: tuple[int, int, int]) -> list[tuple[int, int, int]]:
            if done and new[0] <= done[-1][1] + 1:
                both = min(new[0], done[-1][0]), max(new[1], done[-1][1])
                if self.seconds(both) <= self.most:
                    return [*done[:-1], (*both, max(new[2], done[-1][2]))]
            return [*done, new]

        return reduce(take, sorted(windows, key=lambda w: w[:2]), [])


def candidates(shots: DataFrame, least: int) -> DataFrame:
    """(film_id, first, last, debut, fin, score) around the shots of (film_id, n, debut, fin, score) that score enough.

    Windows grow and join by what came before, so a film is one group of narrow rows."""

    def fold_film(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["debut", "n"])
        run = Run(rows.debut.to_numpy(float), rows.fin.to_numpy(float))
        found = run.united([(*run.around(i), int(s)) for i, s in enumerate(rows.score) if s >= least])
        n = rows.n.tolist()
        out = [(rows.film_id.iloc[0], n[a], n[b], run.start[a], run.end[b], s) for a, b, s in found]
        return pd.DataFrame(out, columns=["film_id", "first", "last", "debut", "fin", "score"])

    kind = {f.name: f.dataType.simpleString() for f in shots.schema}
    schema = f"film_id {kind['film_id']}, first {kind['n']}, last {kind['n']}, debut double, fin double, score long"
    return shots.select("film_id", "n", "debut", "fin", "score").groupBy("film_id").applyInPandas(fold_film, schema)


def ranked(windows: DataFrame, whole_films: bool = False) -> DataFrame:
    """Windows by score, film and start; those of whole films by film and start."""
    return windows.orderBy(*([] if whole_films else [F.desc("score")]), "film_id", "debut")


def packed(shots: DataFrame, aim: float = AIM, most: float = MOST) -> DataFrame:
    """(film_id, first, last, debut, fin): whole films in consecutive windows, filled shot by shot up to the aimed length.

    A window is the last entry of an array that grows along the shots of a contiguous run."""
    n = shots.schema["n"].dataType.simpleString()
    window = f"struct<first:{n},last:{n},debut:double,fin:double>"
    shots_ = F.array_sort(F.collect_list(F.struct(F.col("debut").cast("double").alias("debut"), "n", F.col("fin").cast("double").alias("fin")))).alias("s")
    fresh = lambda x: F.struct(x["n"].alias("first"), x["n"].alias("last"), x["debut"].alias("debut"), x["fin"].alias("fin"))
    longer = lambda w, x: F.struct(w["first"].alias("first"), x["n"].alias("last"), w["debut"].alias("debut"), x["fin"].alias("fin"))
    open_ = lambda w, x: (w["fin"] - w["debut"] < aim) & (x["fin"] - w["debut"] <= most)
    last = lambda a: F.element_at(a, -1)
    step = lambda a, x: F.when((F.size(a) > 0) & open_(last(a), x), F.concat(F.slice(a, 1, F.greatest(F.size(a), F.lit(1)) - 1), F.array(longer(last(a), x)))).otherwise(F.concat(a, F.array(fresh(x))))
    rows = islands(shots).groupBy("film_id", "island").agg(shots_)
    return rows.select("film_id", F.inline(F.aggregate("s", F.array().cast(f"array<{window}>"), step)))


def latest(runs: DataFrame) -> DataFrame:
    """Of each (film_id, id) the row with the greatest run_ts; of equal ones the row that is greatest as text."""
    return runs.groupBy("film_id", "id").agg(F.max_by(F.struct(*runs.columns), F.struct("run_ts", F.to_json(F.struct(*runs.columns)))).alias("r")).select("r.*")
