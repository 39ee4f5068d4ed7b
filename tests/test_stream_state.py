"""The keyed state processors against the definitions, with in-memory state, years of events and rows in any order."""

import random

import pandas as pd
import pytest

from riskloom.functions.columns import SECOND
from riskloom.operators.history import COUNT_WINDOWS, DISTINCT_WINDOWS, NOVELTY, SUM_WINDOWS
from riskloom.streaming import state
from riskloom.streaming.state import DAY_US, HOUR_US, CustomerHistory, DeviceCustomers


class Fake:
    """A value, a list or a map, that counts what is read of it."""

    def __init__(self):
        self.clear()
        self.read = 0

    def clear(self):
        self.value, self.items, self.entries = None, [], {}

    def exists(self):
        return self.value is not None or bool(self.items)

    def get(self):
        found = self.value if self.value is not None else list(self.items)
        self.read += len(str(found))
        return found

    def update(self, value):
        self.value = value

    def put(self, rows):
        assert rows
        self.items = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.items += rows

    def containsKey(self, key):  # noqa: N802
        return key in self.entries

    def getValue(self, key):  # noqa: N802
        self.read += len(str(self.entries[key]))
        return self.entries[key]

    def updateValue(self, key, value):  # noqa: N802
        self.entries[key] = value

    def removeKey(self, key):  # noqa: N802
        self.entries.pop(key, None)

    def rows(self):
        return (self.value is not None) + len(self.items) + len(self.entries)


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def _make(self, name, *_):
        return self.states.setdefault(name, Fake())

    getListState = getValueState = getMapState = _make  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class Stream:
    """One key: batches, a watermark behind the latest row, and timers that it passes."""

    def __init__(self, processor, delay_us):
        self.processor, self.handle, self.delay, self.watermark = processor, Handle(), delay_us, 0
        processor.init(self.handle)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark // 1000

    def send(self, rows):
        rows = [r for r in rows if r["us"] >= self.watermark]
        out = list(self.processor.handleInputRows(("K",), iter([pd.DataFrame(rows).assign(sent=0)]), self)) if rows else []
        self.advance(max([self.watermark, *(r["us"] - self.delay for r in rows)]))
        return pd.concat(out).to_dict("records") if out else []

    def advance(self, watermark):
        self.watermark = watermark
        for at in sorted(t for t in self.handle.timers if t * 1000 <= watermark):
            self.handle.timers.discard(at)
            list(self.processor.handleExpiredTimer(("K",), self, None))

    def rows(self):
        return {name: s.rows() for name, s in self.handle.states.items() if s.rows()}


STEPS = [0, 0, 20, 200, 4000, 86_400, 9 * 86_400]


def events(n=160, seed=11, steps=STEPS):
    rng, us, rows = random.Random(seed), 1_700_000_000 * SECOND, []
    for i in range(n):
        us += rng.choice(steps) * SECOND + rng.choice([0, 0, 137])
        rows.append(dict(us=us, transaction_id=f"T{i:05d}", cents=rng.randint(1, 10**6), lat=rng.uniform(-50, 50), lon=rng.choice([0.0, None]),
                         merchant_id=f"M{rng.randint(0, 4)}", country=f"N{rng.randint(0, 3)}", city=rng.choice([None, "", "c1", "c2", "c3"]),
                         device_id=rng.choice([None, "D1", "D2", "D3"]), customer_id=f"C{rng.randint(0, 5)}", row=f"row {i}"))
    return rows


def ordered_batches(rows):
    """Cut only where the time moves on, as an in-order source would."""
    cuts = [i for i in range(1, len(rows)) if rows[i]["us"] > rows[i - 1]["us"]]
    edges = [0, *cuts[5::9], len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


def shuffled_batches(rows, seed):
    """Rows that are up to a few days late."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r["us"] + rng.choice([0, 0, 0, 3, 9]) * DAY_US)
    return [late[a : a + 11] for a in range(0, len(late), 11)]


def check_customer(rows, got, forget=None):
    for r in rows:
        past = [p for p in rows if p["us"] < r["us"]]
        if forget is not None:  # what lies before a gap does not count
            times = sorted({p["us"] for p in past} | {r["us"]})
            start = max([times[0], *(b for a, b in zip(times, times[1:]) if b - a > forget)])
            past = [p for p in past if p["us"] >= start]
        g = got[r["transaction_id"]]
        assert g["n_past"] == len(past) and g["cents_past"] == float(sum(p["cents"] for p in past)) and g["row"] == r["row"]
        if past:
            mean = sum(p["cents"] for p in past) / len(past)
            spread = (sum((p["cents"] - mean) ** 2 for p in past) / len(past)) ** 0.5
            assert abs(g["std_cents"] - spread) < 1e-3
            last = max(past, key=lambda p: (p["us"], p["transaction_id"]))
            assert (g["prev_us"], g["prev_id"], g["prev_lat"]) == (last["us"], last["transaction_id"], last["lat"])
            assert pd.isna(g["prev_lon"]) if last["lon"] is None else g["prev_lon"] == last["lon"]
        else:
            assert pd.isna(g["prev_us"]) and pd.isna(g["std_cents"])
        for name, seconds in COUNT_WINDOWS.items():
            assert g[f"n_{name}"] == sum(p["us"] >= r["us"] - seconds * SECOND for p in past)
        for name, seconds in SUM_WINDOWS.items():
            assert g[f"cents_{name}"] == sum(p["cents"] for p in past if p["us"] >= r["us"] - seconds * SECOND)
        for name, (column, seconds) in DISTINCT_WINDOWS.items():
            assert g[f"d_{name}"] == len({p[column] for p in past if p["us"] >= r["us"] - seconds * SECOND} - {None})
        for name, column in NOVELTY.items():
            assert g[f"new_{name}"] == ((r[column] or "") not in {p[column] or "" for p in past})


def latest(out):
    best = {}
    for g in out:
        if g["transaction_id"] not in best or g["version"] > best[g["transaction_id"]]["version"]:
            best[g["transaction_id"]] = g
    return best


def test_customer_state_folds_old_events():
    rows, stream = events(), Stream(CustomerHistory(), DAY_US)
    out = [g for b in ordered_batches(rows) for g in stream.send(b)]
    assert len(out) == len(rows) and {g["version"] for g in out} == {0}
    check_customer(rows, latest(out))
    assert stream.processor.history.older["n"] > len(rows) / 2 and stream.rows()["hours"] < len(rows) / 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_late_rows_change_later_ones(seed):
    rows = events(140, seed)
    stream = Stream(CustomerHistory(), 400 * DAY_US)
    out = [g for b in shuffled_batches(rows, seed) for g in stream.send(b)]
    assert len(out) > len(rows)
    check_customer(rows, latest(out))
    device = Stream(DeviceCustomers(), 400 * DAY_US)
    got = latest([g for b in shuffled_batches(rows, seed) for g in device.send(b)])
    check_device(rows, got)


def test_late_rows_behind_the_watermark_are_left_out():
    rows = events(140, 4, [20, 4000, 86_400])
    stream = Stream(CustomerHistory(), 5 * DAY_US)
    out = [g for b in shuffled_batches(rows, 4) for g in stream.send(b)]
    taken = {g["transaction_id"] for g in out}
    assert len(taken) < len(rows)
    check_customer([r for r in rows if r["transaction_id"] in taken], latest(out))


def check_device(rows, got):
    for r in rows:
        assert got[r["transaction_id"]]["device_customers"] == len({p["customer_id"] for p in rows if r["us"] - DAY_US <= p["us"] < r["us"]})


def test_device_state_keeps_one_day_and_then_nothing():
    rows, stream = events(), Stream(DeviceCustomers(), HOUR_US)
    out = [g for b in ordered_batches(rows) for g in stream.send(b)]
    check_device(rows, latest(out))
    assert sum(stream.rows().values()) < len(rows) / 2
    stream.advance(rows[-1]["us"] + 2 * DAY_US)
    assert stream.rows() == {} and not stream.handle.timers


def test_rows_sent_again_count_once():
    rows, stream = events(60), Stream(DeviceCustomers(), 400 * DAY_US)
    out = [g for b in ordered_batches(rows) for g in stream.send(b)]
    again = [r | {"row": "other"} for r in rows[20:30]]
    out += stream.send(again)
    check_device(rows, latest(out))
    assert sum(s["us"] is not None for s in rows) == sum(len(h) for h in map(lambda v: state.json.loads(v[0]), stream.handle.states["hours"].entries.values()))


@pytest.mark.parametrize("replay", [False, True])
def test_idle_customers_are_forgotten_by_event_time(replay):
    rows = events(120, 6, [20, 4000, 86_400, 40 * 86_400])
    stream = Stream(CustomerHistory(idle_days=35), 10**9 * SECOND if replay else DAY_US)  # a replay has no watermark yet
    batches = [rows] if replay else ordered_batches(rows)
    out = [g for b in batches for g in stream.send(b)]
    check_customer(rows, latest(out), 35 * DAY_US)
    if not replay:
        stream.advance(rows[-1]["us"] + 36 * DAY_US)
        assert stream.rows() == {} and not stream.handle.timers
    with pytest.raises(ValueError, match="longest window"):
        CustomerHistory(idle_days=7)


def test_a_trigger_reads_as_much_of_a_large_key_as_of_a_small_one():
    read = {}
    for n in (300, 60_000):
        rng, stream = random.Random(n), Stream(CustomerHistory(), HOUR_US)
        start, month = 1_700_000_000 * SECOND, 30 * DAY_US
        template = events(1)[0]
        make = lambda k, us: template | {"us": us, "transaction_id": f"T{k:06d}", "merchant_id": f"M{k % 9}", "device_id": f"D{k % 3}"}
        rows = [make(k, start + month * k // n + rng.randrange(100)) for k in range(n)]
        for a in range(0, n, 2000):
            stream.send(rows[a : a + 2000])
        before = {k: s.read for k, s in stream.handle.states.items()}
        stream.send([make(n + k, start + month + k * SECOND) for k in range(5)])
        read[n] = sum(s.read - before[k] for k, s in stream.handle.states.items())
        held = sum(len(str(e)) for e in stream.handle.states["hours"].entries.values())
        assert n == 300 or read[n] < held / 25  # the head, the hours at the windows' edges, and the rows that may change
    assert read[60_000] < 20 * read[300]


@pytest.mark.parametrize("small", [0, 60, 10**6])
def test_small_and_large_keys_give_the_same(monkeypatch, small):
    """A key's state moves to entries of its own once it has grown, also between late rows."""
    monkeypatch.setattr(state, "SMALL", small)
    rows = events(140, 2)
    stream = Stream(CustomerHistory(), 400 * DAY_US)
    out = [g for b in shuffled_batches(rows, 2) for g in stream.send(b)]
    check_customer(rows, latest(out))
    assert (state.ALL,) in stream.handle.states["hours"].entries or small < 10**6
    assert len(stream.handle.states["hours"].entries) > 1 or small == 10**6


def test_a_small_key_needs_few_accesses(monkeypatch):
    """Each access to the state is a round trip: their number must not follow the rows of a small key."""
    calls = []
    for name in ("exists", "get", "update", "put", "appendList", "containsKey", "getValue", "updateValue", "removeKey"):
        monkeypatch.setattr(Fake, name, lambda self, *a, own=getattr(Fake, name): calls.append(1) or own(self, *a))
    rows, stream = events(72, 5), Stream(CustomerHistory(), 400 * DAY_US)
    for start in range(0, 72, 24):
        calls.clear()
        stream.send(rows[start : start + 24])
        assert len(calls) <= 8


def test_all_states_of_a_short_key_are_one_entry():
    """Each access to the state is a round trip: a short key needs one to read and one to write, a long one has entries of its own."""
    schema = state.T.StructType([f for f in state.STATS.fields if f.name != "customer_id"])
    answers = {}
    for limit in (100_000, 3_000, 0):
        stream, keyed = Stream(CustomerHistory(), 400 * DAY_US), state.ByRow(CustomerHistory(), schema)
        handle = Handle()
        keyed.init(handle)
        keyed.pack.limit = limit
        for batch in shuffled_batches(events(140, 2), 2):
            sent = [("K", None, state.json.dumps({n: v for n, v in r.items() if n != "row"} | {"sent": 0}) + "\t" + r["row"]) for r in batch]
            for out in keyed.handleInputRows(("K",), iter(sent), stream):
                about, *rows = out["answers"].split("\n")
                answers.setdefault(limit, []).extend(zip(state.json.loads(about), rows, strict=True))
        packed = {n for n, s in handle.states.items() if s.rows()} == {"packed"}
        assert packed == (limit == 100_000)
    assert answers[0] == answers[3_000] == answers[100_000]
    about, row = answers[0][0]
    one = dict(zip(state._by_kind(schema)["n"], about["n"], strict=False))
    assert one["n_past"] == 0 and one["version"] == 0 and row == "row 0"


def test_sights_of_a_large_key_lie_in_parts():
    """A device with many customers: accesses to the state follow the parts, not the customers."""
    stream = Stream(DeviceCustomers(), 400 * DAY_US)
    start, calls = 1_700_000_000 * SECOND, []
    rows = [events(1)[0] | {"us": start + k * SECOND, "transaction_id": f"T{k:05d}", "customer_id": f"C{k % 3000}"} for k in range(6000)]
    for a in range(0, 6000, 2000):
        out = stream.send(rows[a : a + 2000])
        seen = stream.handle.states["seen"]
        calls.append(len(seen.entries))
    assert [g["device_customers"] for g in out][-1] == 3000 and len(out) == 2000
    assert 0 < max(calls) <= 2 * 3000 / state.SIGHTS + 2
    assert sum(len(state.json.loads(v[0])) for v in stream.handle.states["seen"].entries.values()) == 3000
