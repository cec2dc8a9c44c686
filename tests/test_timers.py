"""Open cases of a key: as a loop over all rows, with a few calls of the state for many rows."""

import random

import pandas as pd

from claimlattice.streaming.timers import OpenCases


class Held:
    """A state and timers of one key, which count how often they are asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_cases_are_those_of_a_loop_with_few_calls():
    rng, within, second = random.Random(12), 600, 1_000_000
    for _ in range(60):
        rows = sorted((rng.randrange(5000) * second, i, rng.random() < 0.4) for i in range(rng.choice([3, 40, 400])))
        cases, held, got = OpenCases(within * second), Held(), []
        cases.init(held)
        each, calls = len(rows) // 4 + 1, 0
        parts = [rows[i : i + each] for i in range(0, len(rows), each)]
        for part in [*parts, []]:
            part = list(part)
            rng.shuffle(part)
            if part:
                list(cases.handleInputRows((7,), iter([pd.DataFrame(part, columns=["at", "id", "opens"])]), At(0)))
            mark = (part and max(r[0] for r in part) // 1000) or 10_000_000
            while held.timers and min(held.timers) <= mark:
                fired = min(held.timers)
                held.timers.remove(fired)
                for out in cases.handleExpiredTimer((7,), At(mark), At(fired)):
                    got += out["id"].tolist()
            calls += 1
        assert sorted(got) == sorted(i for t, i, opens in rows if opens and not any(not o and t <= u <= t + within * second for u, _, o in rows))
        assert not (held.value and held.value[0]) and not held.timers and held.calls <= 16 * calls
