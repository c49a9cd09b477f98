"""Validity intervals against a walk over each object's runs."""

import datetime as dt
import random

from stocktake.operators.history import as_of, object_history

RUNS = [dt.datetime(2024, 1, d) for d in (1, 3, 9, 20)]


def walk(rows):
    out = []
    runs = {w: sorted({r[1] for r in rows if r[0] == w}) for w in {r[0] for r in rows}}
    for w, key in {(r[0], r[2]) for r in rows}:
        state = {r[1]: r[3] for r in sorted(rows, key=lambda r: (r[3] is not None, r[3]), reverse=True) if (r[0], r[2]) == (w, key)}
        open_at = None
        for i, t in enumerate(runs[w]):
            if t in state and (open_at is None or state[runs[w][i - 1]] != state[t]):
                if open_at is not None:
                    out.append((key, state[runs[w][i - 1]], w, open_at, t))
                open_at = t
            elif t not in state and open_at is not None:
                out.append((key, state[runs[w][i - 1]], w, open_at, t))
                open_at = None
        if open_at is not None:
            out.append((key, state[runs[w][-1]], w, open_at, None))
    return out


def test_intervals_of_random_runs(spark):
    rng = random.Random(4)
    rows = [(w, t, k, rng.choice(["a", "b", None])) for w in ("x", "y", None) for t in RUNS[:4 if w else 2]
            for k in range(12) if rng.random() < 0.7]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "_workspace string, _collected_at timestamp, key long, state string")
    got = object_history(df, ["key"])
    assert got.columns == ["key", "state", "_workspace", "valid_from", "valid_to", "n_runs"]
    assert sorted(map(str, (tuple(r)[:5] for r in got.collect()))) == sorted(map(str, walk(rows)))
    for t in RUNS:
        seen = sorted(map(str, {(r[2], r[3], r[0]) for r in rows if r[1] == t}))
        back = as_of(got, str(t + dt.timedelta(hours=5))).select("key", "state", "_workspace")
        if t in RUNS[:2]:
            assert sorted(map(str, map(tuple, back.collect()))) == seen
        else:  # one workspace has no such run: its last one counts
            assert sorted(map(str, map(tuple, back.where("_workspace IS NOT NULL").collect()))) == seen


def test_no_rows(spark):
    df = spark.createDataFrame([], "_workspace string, _collected_at timestamp, key long, state string")
    assert object_history(df, ["key"]).count() == 0
