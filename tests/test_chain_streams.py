"""The fold of the challenge stream without Spark, and streams that run side by side."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd
import pytest

from tonearm.plans import streams
from tonearm.streaming import jobs


class State:
    """What the fold uses of a keyed state."""

    def __init__(self, held=None):
        self.held, self.hasTimedOut, self.timeout = held, False, None

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, held):
        self.held = held

    def setTimeoutTimestamp(self, at):
        self.timeout = at

    def getCurrentWatermarkMs(self):
        return 0


def packed(number, ns, *offers):
    return [number, *ns, *[x for o in offers for x in o]]


def test_days_travel_as_one_list_and_leave_as_plain_columns():
    offers = ((1, 2), (2, 1), (3, 3), (4, 1), (5, 1), (6, 4))
    days = [packed(20, [2, 0, 1, 0, 0, 0], *offers), packed(21, [0, 1, 3, 0, 1, 0], *offers[::-1]), packed(20, [9] * 6, *offers)]
    state = State()
    frames = list(jobs.fold_days((7,), iter([pd.DataFrame({"packed": [pd.Series(d).to_numpy() for d in days[1:]]}), pd.DataFrame({"packed": [pd.Series(days[0]).to_numpy()]})]), state))
    assert len(frames) == 1
    assert [str(t) for t in frames[0].dtypes] == ["int64"] + ["int32"] * 6
    # Day 20 is given twice, once with other counts: the sort is stable, so the first one met counts.
    assert frames[0].values.tolist() == [
        [7, 20, 1, 2, 0, 2, 1], [7, 20, 2, 1, 0, 1, 1], [7, 20, 3, 3, 0, 3, 1],
        [7, 21, 6, 4, 0, 0, 0], [7, 21, 5, 1, 0, 1, 1], [7, 21, 4, 1, 0, 0, 0],
    ]
    assert state.held == (21, [6, 4], [4, 1]) and state.timeout == 23 * 86_400_000
    again = list(jobs.fold_days((7,), iter([pd.DataFrame({"packed": [pd.Series(days[1]).to_numpy()]})]), state))
    assert len(again[0]) == 0 and list(again[0].columns) == list(frames[0].columns) and state.held == (21, [6, 4], [4, 1])


@pytest.mark.parametrize("fails", [False, True])
def test_streams_run_side_by_side(monkeypatch, fails):
    """All are started before the first is waited for, and none outlives a failure."""
    told = []

    def start(stream, path, mode, shape=None):
        def wait():
            told.append(f"wait {stream}")
            if fails:
                raise RuntimeError(stream)

        told.append(f"start {stream}")
        return SimpleNamespace(awaitTermination=wait, stop=lambda: told.append(f"stop {stream}"))

    monkeypatch.setattr(streams.jobs, "start", start)
    monkeypatch.setattr(streams, "run_dir", lambda spark, name: f"/{name}")
    run = lambda: streams._run_all(SimpleNamespace(spark=None), a=("A", "update"), b=("B", "append", None))
    if fails:
        with pytest.raises(RuntimeError):
            run()
    else:
        assert run() == ["/a", "/b"]
    assert told[:3] == ["start A", "start B", "wait A"] and told[-2:] == ["stop A", "stop B"]
