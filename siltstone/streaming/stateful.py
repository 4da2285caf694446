"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_usage(events: DataFrame, hours: int, late_hours: int = 24) -> DataFrame:
    """(event_id, user_id, ts, total, n, kind): at each event, the sum and count of the user's values of the last `hours`, itself included.

    A message key counts once, with the largest value it was seen with.  An event up to
    `late_hours` behind the user's latest one is taken in, and the sums it changes are given
    again with kind ``corrected``; a later one changes nothing and is given with a null sum and
    kind ``late``.  A user's state is the events of the window and of the time allowed for lateness.
    """
    width, allowed = hours * 3_600_000_000, late_hours * 3_600_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(dict(zip(("event_id", "ts", "value", "total"), state.get))) if state.exists else pd.DataFrame({"event_id": [], "ts": [], "value": [], "total": []})
        known = known.astype({"event_id": "int64", "ts": "int64", "value": "float64", "total": "float64"})
        new = pd.concat(frames)[["event_id", "ts", "value"]]
        new["ts"] = new["ts"].astype("datetime64[us]").astype("int64")
        floor = known["ts"].max() - allowed if len(known) else new["ts"].min()
        late, new = new[new["ts"] < floor], new[new["ts"] >= floor]
        both = pd.concat([known.drop(columns="total"), new]).sort_values(["event_id", "value"]).drop_duplicates("event_id", keep="last").sort_values(["ts", "event_id"])
        begin = both["ts"].searchsorted(both["ts"] - width, side="right")
        sums = np.concatenate([[0.0], both["value"].cumsum()])
        both = both.assign(total=sums[1:] - sums[begin], n=np.arange(1, len(both) + 1) - begin)
        before = known.set_index("event_id")["total"].reindex(both["event_id"]).to_numpy()
        first, changed = np.isnan(before), np.abs(before - both["total"].to_numpy()) > 1e-9
        # What lies behind the allowed time and its window changes no sum any more; sums behind the allowed time can't change.
        settled = both["ts"].to_numpy() < floor
        both["kind"] = np.where(first, "first", "corrected")
        out = both[first | (changed & ~settled)]
        recent = both[both["ts"] > both["ts"].max() - width - allowed] if len(both) else both
        state.update(tuple(recent[c].tolist() for c in ("event_id", "ts", "value", "total")))
        given = late.drop_duplicates("event_id").assign(total=np.nan, n=0, kind="late")
        both_kinds = pd.concat([x for x in (out, given) if len(x)]) if len(out) + len(given) else out
        rows = both_kinds.assign(ts=both_kinds["ts"].astype("datetime64[us]"), user_id=key[0], total=both_kinds["total"].astype(object).where(both_kinds["total"].notna(), None))
        yield rows[["event_id", "user_id", "ts", "total", "n", "kind"]]

    return events.groupBy("user_id").applyInPandasWithState(
        step, "event_id long, user_id long, ts timestamp, total double, n long, kind string", "ids array<long>, times array<long>, values array<double>, totals array<double>", "append", GroupStateTimeout.NoTimeout
    )


def admitted(offers: DataFrame) -> DataFrame:
    """The seen-set gate on a stream: an offer's URL is let through once, ever.

    Its state is the set of all URLs and grows with them; a state store on disk holds it.
    """
    return offers.dropDuplicates(["url"])


def dead_board_counter(probes: DataFrame, cap: int = 3) -> DataFrame:
    """(board, misses) updates from probes (board, missing): a success deletes the counter, a miss adds one, up to the cap."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses = state.get[0] if state.exists else 0
        for missing in pd.concat(frames).sort_values("seq")["missing"]:  # in order over all of the trigger's frames
            misses = min(cap, misses + 1) if missing else 0
        if misses:
            state.update((misses,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"board": [key[0]], "misses": [misses]})

    return probes.groupBy("board").applyInPandasWithState(step, "board string, misses int", "misses int", "update", GroupStateTimeout.NoTimeout)
