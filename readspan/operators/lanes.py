"""Lanes of a week's calendar: books on consecutive days keep their lane."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def lanes(days: DataFrame, week: str = "week", day: str = "day", book: str = "book", seconds: str = "seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, week, book, first_day, last_day, lane)``: runs of days of a book, in the lowest lane that is free all the run.

    Greedy by first day, then by most seconds; a week of a reader (``keys``, such as the device) is a handful of rows.
    """

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        runs: list[list] = []
        for b, own in rows.sort_values(day).groupby(book, sort=True):
            for d, s in zip(own[day], own[seconds], strict=True):
                if runs and runs[-1][0] == b and (d - runs[-1][2]).days == 1:
                    runs[-1][2], runs[-1][3] = d, runs[-1][3] + s
                else:
                    runs.append([b, d, d, s])
        busy: list[list] = []
        out = []
        for b, lo, hi, s in sorted(runs, key=lambda r: (r[1], -r[3], r[0])):
            lane = next((i for i, taken in enumerate(busy) if all(hi < x or lo > y for x, y in taken)), len(busy))
            if lane == len(busy):
                busy.append([])
            busy[lane].append((lo, hi))
            out.append((*(rows[c].iloc[0] for c in (*keys, week)), b, lo, hi, lane))
        return pd.DataFrame(out, columns=[*keys, week, book, "first_day", "last_day", "lane"])

    kinds = dict(days.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in (*keys, week, book))
    return days.groupBy(*keys, week).applyInPandas(place, f"{columns}, first_day date, last_day date, lane int")
