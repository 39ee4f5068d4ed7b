"""Keyed streaming state behind the history features, cut by the hour.

A key's state is a head (count, sum of amounts, and per column the values last seen, of each hour that has events), the
events of each hour, the first and last sight of every value, and the rows that may still change. A trigger whose rows
are later than all before them reads the head, the hours at the edges of its windows and the values it holds, so a key
with many events costs about as much as one with few. Each access to the state is a round trip, so they are few: sights lie in
parts of about ``SIGHTS`` by a hash, and rows that may change in parts of up to ``ROWS``. A key of at most ``SMALL`` events and
sights has its events in one entry and its sights in the head, and all states of a key are one entry while they are short (``Packed``). Every row is answered from strictly earlier events: rows of the
same time never see each other. The statistics are the raw ones of ``operators.history``, which finishes them with the
same column code as in batch.

Late rows: a row that is not later than its key's last one, but within the watermark, is put in its place, and the later
rows that it changes are emitted again with a higher ``version``; ``latest_rows`` keeps the highest. Such a trigger reads
all hours of the key.

Expiry is by event time. Hours that the watermark has left a whole horizon behind (30 days for customers, one for
devices) are folded into totals. ``idle_days`` forgets a customer altogether so long after the last event: the next one
finds a new customer, whether or not the timer has fired before, so a replay gives the same rows. A device that adds
nothing for a day leaves no state.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate, groupby
from operator import itemgetter
from typing import Any
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.functions.columns import SECOND, micros
from riskloom.operators.history import COUNT_WINDOWS, DEVICE_WINDOW, DISTINCT_WINDOWS, NOVELTY, SUM_WINDOWS

HOUR_US = 3600 * SECOND
DAY_US = 24 * HOUR_US
HORIZON_US = max(seconds for _, seconds in DISTINCT_WINDOWS.values()) * SECOND
WIDTHS = {*COUNT_WINDOWS.values(), *SUM_WINDOWS.values()}
EVENT_FIELDS = ["us", "transaction_id", "cents", "lat", "lon", "merchant_id", "country", "city", "device_id"]
#: Events and sights up to which a key is a small one, and where its events are.
SMALL, ALL = 600, -1
#: Sights and rows of a part, parts of rows from which on neighbours are joined, and answers of an output row.
SIGHTS, ROWS, PARTS, ANSWERS = 200, 256, 8, 200
#: Characters up to which all states of a key are one entry.
PACKED = 100_000
#: Row payloads travel as JSON with microseconds kept.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
STATS = T.StructType([
    T.StructField("us", T.LongType()), T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()), T.StructField("n_past", T.LongType()),
    T.StructField("cents_past", T.DoubleType()), T.StructField("std_cents", T.DoubleType()),
    T.StructField("prev_us", T.LongType()), T.StructField("prev_id", T.StringType()),
    T.StructField("prev_lat", T.DoubleType()), T.StructField("prev_lon", T.DoubleType()),
    *[T.StructField(f"n_{w}", T.LongType()) for w in COUNT_WINDOWS],
    *[T.StructField(f"cents_{w}", T.LongType()) for w in SUM_WINDOWS],
    *[T.StructField(f"d_{n}", T.LongType()) for n in DISTINCT_WINDOWS],
    *[T.StructField(f"new_{n}", T.BooleanType()) for n in NOVELTY],
    T.StructField("version", T.LongType()), T.StructField("row", T.StringType()),
])


def _plain(rows: pd.DataFrame, fields: list[str]) -> list[dict]:
    """Rows as dictionaries; absent fields are None, whatever pandas has made of them."""
    values = rows[fields].astype(object).where(rows[fields].notna(), None).to_dict("records")
    for v in values:
        v["us"] = int(v["us"])
    return values


class Hour:
    """The events of one hour in order of (us, transaction_id)."""

    def __init__(self, events: list[list]) -> None:
        self.events = sorted(events, key=lambda e: (e[0], e[1]))
        self.us = [e[0] for e in self.events]
        self._cents: list[int] | None = None

    def cents_before(self, k: int) -> int:
        if self._cents is None:
            self._cents = [0, *accumulate(e[2] for e in self.events)]
        return self._cents[k]


class History:
    """The state of the current key. ``counted`` columns have their distinct values counted in windows, ``known`` ones
    keep the first sight of each value (null as the empty text). An event is [us, id, cents, lat, lon, *values]."""

    def __init__(self, handle: StatefulProcessorHandle, counted: list[str], known: list[str], horizon_us: int) -> None:
        self.counted, self.known, self.horizon = counted, known, horizon_us
        self.columns = list(dict.fromkeys([*counted, *known]))
        self.handle = handle
        self.head_state = handle.getValueState("head", "json string")
        self.hours_state = handle.getMapState("hours", "hour long", "events string")
        self.seen_state = handle.getMapState("seen", "part long", "sights string")
        self.rows_state = handle.getMapState("rows", "part long", "rows string")

    def load(self) -> None:
        """Read the head; all else is read when it is asked for."""
        found = self.head_state.get()
        head = json.loads(found[0]) if found else {}
        self.older = head.get("older", {"n": 0, "cents": 0, "squares": 0, "last": None})
        #: Per hour: events, their cents, squares, and for each counted column the values last seen then.
        self.totals = {int(h): v for h, v in head.get("hours", {}).items()}
        self.last, self.timer = head.get("last"), head.get("timer")
        #: Parts of the rows that may change: number, rows, their first and last time; what was stored later comes later.
        self.kept: list[list[int]] = head.get("kept", [])
        self.hours: dict[int, Hour] = {}
        self.seen: dict[tuple[str, Any], tuple[int, int] | None] = {}
        #: Of a small key the events of each hour and the sights; None once they lie in states of their own.
        small = not head or "sights" in head
        self.sights: dict[str, Any] | None = head.get("sights", {}) if small else None
        self.packed: dict[int, list[list]] | None = self._all_events() if small and self.totals else {} if small else None
        self.changed = False
        #: Of a large key how many parts its sights lie in, how many there are, the parts that were read, and those that have changed.
        self.parts, self.n_sights = head.get("parts", (1, 0))
        self.read: dict[int, dict[str, Any]] = {}
        self.written: set[int] = set()
        self._order()

    def _order(self) -> None:
        self.order = sorted(self.totals)
        self.lasts: dict[tuple[str, int], list[int]] = {}
        width = 3 + len(self.counted)
        self.sums = [[0, *accumulate(self.totals[h][k] for h in self.order)] for k in range(width)]

    def hour(self, h: int) -> Hour:
        if h not in self.hours:
            self.hours[h] = Hour(self._events_of(h) if h in self.totals else [])
        return self.hours[h]

    def _all_events(self) -> dict[int, list[list]]:
        events = json.loads(self.hours_state.getValue((ALL,))[0])
        return {h: list(own) for h, own in groupby(events, key=lambda e: e[0] // HOUR_US)}

    def _events_of(self, h: int) -> list[list]:
        return json.loads(self.hours_state.getValue((h,))[0]) if self.packed is None else self.packed[h]

    def _put_events(self, h: int, events: list[list]) -> None:
        if self.packed is None:
            self.hours_state.updateValue((h,), (json.dumps(events, separators=(",", ":")),))
        else:
            self.packed[h], self.changed = events, True

    def _drop_events(self, h: int) -> None:
        if self.packed is None:
            self.hours_state.removeKey((h,))
        else:
            del self.packed[h]
            self.changed = True

    def _place(self, entity: str) -> int:
        return crc32(entity.encode("utf-8", "surrogatepass")) % self.parts

    def _sights_of(self, part: int) -> dict[str, Any]:
        if part not in self.read:
            self.read[part] = json.loads(self.seen_state.getValue((part,))[0])
        return self.read[part]

    def _put_sight(self, entity: str, sight: tuple[int, int]) -> None:
        if self.sights is None:
            part = self._place(entity)
            held = self._sights_of(part)
            self.n_sights += entity not in held
            held[entity] = sight
            self.written.add(part)
        else:
            self.sights[entity] = sight

    def _drop_sight(self, entity: str) -> None:
        if self.sights is None:
            part = self._place(entity)
            if self._sights_of(part).pop(entity, None) is not None:
                self.n_sights -= 1
                self.written.add(part)
        else:
            self.sights.pop(entity, None)

    def _unpack(self) -> None:
        """Give each hour its own place, and the sights theirs: the key has grown."""
        packed, sights = self.packed, self.sights
        self.packed = self.sights = None
        self.hours_state.removeKey((ALL,))
        for h, events in packed.items():
            self._put_events(h, events)
        self.parts, self.n_sights, self.read, self.written = 1, len(sights), {0: sights}, {0}

    def _store_sights(self) -> None:
        """Write the parts that have changed; with more than twice or less than an eighth of the sights that parts are for, deal
        them out anew."""
        fit = max(1, -(-self.n_sights // SIGHTS))
        if fit > 2 * self.parts or 8 * fit < self.parts:
            every = [item for part in range(self.parts) for item in self._sights_of(part).items()]
            for part in range(fit, self.parts):
                self.seen_state.removeKey((part,))
            self.parts, self.read, self.written = fit, {part: {} for part in range(fit)}, set(range(fit))
            for entity, sight in every:
                self.read[self._place(entity)][entity] = sight
        for part in sorted(self.written):
            self.seen_state.updateValue((part,), (json.dumps(self.read[part], separators=(",", ":")),))
        self.written = set()

    def sight(self, column: str, value: Any) -> tuple[int, int] | None:
        """First and last time of a value."""
        if (column, value) not in self.seen:
            entity = _entity(column, value)
            found = (self._sights_of(self._place(entity)) if self.sights is None else self.sights).get(entity)
            self.seen[column, value] = None if found is None else (int(found[0]), int(found[1]))
        return self.seen[column, value]

    def first(self, column: str, value: Any) -> int | None:
        """First sight of a value of a known column; null and the empty text are one."""
        sights = [self.sight(column, v) for v in ((None, "") if value in (None, "") else (value,))]
        return min((s[0] for s in sights if s is not None), default=None)

    def before(self, x: int) -> tuple[int, int]:
        """Events before time x, and their cents."""
        i = bisect_left(self.order, x // HOUR_US)
        n, cents = self.older["n"] + self.sums[0][i], self.older["cents"] + self.sums[1][i]
        if i < len(self.order) and self.order[i] == x // HOUR_US:
            hour = self.hour(self.order[i])
            k = bisect_left(hour.us, x)
            n, cents = n + k, cents + hour.cents_before(k)
        return n, cents

    def squares(self) -> int:
        return self.older["squares"] + self.sums[2][-1]

    def values_since(self, column: str, x: int) -> int:
        """Values of a counted column whose last sight is at x or later."""
        sums = self.sums[3 + self.counted.index(column)]
        i = bisect_right(self.order, x // HOUR_US)
        n = sums[-1] - sums[i]
        if i and self.order[i - 1] == x // HOUR_US:
            last = self._last_sights(column, self.order[i - 1])
            n += len(last) - bisect_left(last, x)
        return n

    def _last_sights(self, column: str, h: int) -> list[int]:
        """When values were last seen, of those whose last sight is in an hour: the times in order."""
        if (column, h) not in self.lasts:
            at = 5 + self.columns.index(column)
            sights = {(e[at], e[0]) for e in self.hour(h).events if e[at] is not None}
            self.lasts[column, h] = sorted(us for value, us in sights if self.sight(column, value)[1] == us)
        return self.lasts[column, h]

    def all_events(self) -> list[list]:
        return [e for h in self.order for e in self.hour(h).events]

    def add(self, events: list[list]) -> None:
        """Put events in their places; ones that are there already stay as they are."""
        spans: dict[tuple[str, Any], tuple[int, int]] = {}
        for h, own in groupby(sorted(events, key=lambda e: (e[0], e[1])), key=lambda e: e[0] // HOUR_US):
            hour = self.hour(h)
            there = {(e[0], e[1]) for e in hour.events}
            fresh = [e for (at, key), e in {(e[0], e[1]): e for e in own}.items() if (at, key) not in there]
            if not fresh:
                continue
            self.hours[h] = Hour([*hour.events, *fresh])
            self._put_events(h, self.hours[h].events)
            total = self.totals.setdefault(h, [0] * (3 + len(self.counted)))
            total[0] += len(fresh)
            total[1] += sum(e[2] for e in fresh)
            total[2] += sum(e[2] ** 2 for e in fresh)
            for e in fresh:  # in order of time
                for at in zip(self.columns, e[5:], strict=True):
                    spans[at] = (spans[at][0] if at in spans else e[0], e[0])
            if self.last is None or fresh[-1][:2] > self.last[:2]:
                self.last = [fresh[-1][0], fresh[-1][1], fresh[-1][3], fresh[-1][4]]
        for (column, value), (low, high) in spans.items():
            self._sighted(column, value, low, high)
        self._order()

    def _sighted(self, column: str, value: Any, low: int, high: int) -> None:
        known = self.sight(column, value)
        first, last = (low, high) if known is None else (min(low, known[0]), max(high, known[1]))
        if value is not None and column in self.counted and (known is None or last != known[1]):
            at = 3 + self.counted.index(column)
            if known is not None and known[1] // HOUR_US in self.totals:
                self.totals[known[1] // HOUR_US][at] -= 1
            self.totals[last // HOUR_US][at] += 1
        if (first, last) != known and (value is not None or column in self.known):
            self._put_sight(_entity(column, value), (first, last))
        self.seen[column, value] = (first, last)

    def fold(self, before_us: int) -> None:
        """Move the hours that end at ``before_us`` or earlier into the totals."""
        gone = [h for h in self.order if (h + 1) * HOUR_US <= before_us]
        for h in gone:
            hour, total = self.hour(h), self.totals.pop(h)
            self.older["n"] += total[0]
            self.older["cents"] += total[1]
            self.older["squares"] += total[2]
            self.older["last"] = [hour.events[-1][k] for k in (0, 1, 3, 4)]
            for k, column in enumerate(self.columns):
                for value in {e[5 + k] for e in hour.events} if column not in self.known else ():
                    if value is not None and (sight := self.sight(column, value)) and sight[1] // HOUR_US <= h:
                        self._drop_sight(_entity(column, value))
                        self.seen[column, value] = None
            self._drop_events(h)
            self.hours.pop(h, None)
        if gone:
            self._order()

    def keep_rows(self, rows: list[tuple], watermark_us: int) -> None:
        """Remember rows that may change, which come in order of time. A part goes unread once the watermark has passed all of it;
        many small ones are joined."""
        for start in range(0, len(rows), ROWS):
            self.kept.append(self._put_rows(max((p[0] for p in self.kept), default=-1) + 1, rows[start : start + ROWS]))
        passed = [p[0] for p in self.kept if p[3] < watermark_us]
        for number in passed:
            self.rows_state.removeKey((number,))
        self.kept = [p for p in self.kept if p[0] not in passed] if passed else self.kept
        if len(self.kept) > PARTS + 2 * sum(p[1] for p in self.kept) // ROWS:
            self._join_parts(watermark_us)

    def _put_rows(self, number: int, rows: list) -> list[int]:
        self.rows_state.updateValue((number,), (_lines([r[:3] for r in rows], [r[3] for r in rows]),))
        return [number, len(rows), min(r[0] for r in rows), max(r[0] for r in rows)]

    def _rows_of(self, number: int) -> list[list]:
        about, *rows = self.rows_state.getValue((number,))[0].split("\n")
        return [[*values, row] for values, row in zip(json.loads(about), rows, strict=True)]

    def _join_parts(self, watermark_us: int) -> None:
        """Join neighbouring parts of no more than ``ROWS`` rows together, without the rows that the watermark has passed."""
        runs: list[list[list[int]]] = []
        for part in self.kept:
            if runs and sum(p[1] for p in runs[-1]) + part[1] <= ROWS:
                runs[-1].append(part)
            else:
                runs.append([part])
        self.kept = []
        for run in runs:
            if len(run) == 1:
                self.kept += run
                continue
            rows = [r for p in run for r in self._rows_of(p[0]) if r[0] >= watermark_us]
            for p in run if not rows else run[1:]:
                self.rows_state.removeKey((p[0],))
            if rows:
                self.kept.append(self._put_rows(run[0][0], rows))

    def open_rows(self) -> dict[str, tuple]:
        """The last version of each row that may change, by its id."""
        return {key: (us, key, version, row) for p in self.kept for us, key, version, row in self._rows_of(p[0])}

    def wake(self, at_us: int) -> None:
        """Set the key's one timer, in event time. One that is due before stays: the key sets the next when it fires."""
        at = -(-at_us // 1000)
        if self.timer is None or at < self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(at)
            self.timer = at

    def store(self) -> None:
        if self.packed is not None and self.sums[0][-1] + len(self.sights) > SMALL:
            self._unpack()
        head = {"older": self.older, "hours": self.totals, "last": self.last, "kept": self.kept, "timer": self.timer}
        if self.packed is not None:
            head["sights"] = self.sights
            if self.changed and self.packed:
                events = [e for h in self.order for e in self.packed[h]]
                self.hours_state.updateValue((ALL,), (json.dumps(events, separators=(",", ":")),))
            elif self.changed:
                self.hours_state.removeKey((ALL,))
        else:
            self._store_sights()
            head["parts"] = [self.parts, self.n_sights]
        self.head_state.update((json.dumps(head, separators=(",", ":")),))

    def forget(self) -> None:
        for state in (self.head_state, self.hours_state, self.seen_state, self.rows_state):
            state.clear()
        if self.timer is not None:
            self.handle.deleteTimer(self.timer)
        self.load()


def _lines(about: list, rows: list[str]) -> str:
    """Values of all rows as a line of JSON, then each row's JSON as it is: JSON has no raw line ends."""
    return "\n".join([json.dumps(about, separators=(",", ":")), *rows])


def _entity(column: str, value: Any) -> str:
    return column if value is None else f"{column}|{value}"


class Distinct:
    """Distinct values of a column in the window before rows that come in order of time."""

    def __init__(self, history: History, column: str, seconds: int) -> None:
        self.history, self.column, self.width = history, column, seconds * SECOND
        self.new: OrderedDict[Any, int] = OrderedDict()  #: last sight within the batch, the oldest first
        self.met: set = set()
        self.old: list[int] = []  #: last sights before the batch, of values met in it

    def at(self, us: int) -> int:
        start = us - self.width
        while self.new and next(iter(self.new.values())) < start:
            self.new.popitem(last=False)
        while self.old and self.old[0] < start:
            heappop(self.old)
        return self.history.values_since(self.column, start) - len(self.old) + len(self.new)

    def add(self, value: Any, us: int) -> None:
        if value is None:
            return
        if value not in self.met:
            self.met.add(value)
            sight = self.history.sight(self.column, value)
            if sight is not None and sight[1] // HOUR_US in self.history.totals:
                heappush(self.old, sight[1])
        self.new[value] = us
        self.new.move_to_end(value)


class _Keyed(StatefulProcessor):
    """What both processors share: order, late rows, folding and timers."""

    fields: list[str]
    idle_us: int | None = None  #: without an event for so long, a key starts anew
    totals_matter = True  #: whether a key is worth keeping once all its hours are folded

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "transaction_id", "sent"], ignore_index=True)
        yield self._frame(key[0], self.answers(_plain(batch, [*self.fields, "row"]), timerValues))

    def answers(self, batch: list[dict], timerValues) -> list[dict]:  # noqa: N803
        """Rows of the current key, in order, with their statistics and versions."""
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        history = self.history
        history.load()
        out: list[dict] = []
        for part in self._parts(batch):
            if self.idle_us is not None and history.last is not None and part[0]["us"] - history.last[0] > self.idle_us:
                history.forget()
            events = [self._event(r) for r in part]
            if history.last is None or part[0]["us"] > history.last[0]:
                found = self._in_order(part)
                history.add(events)
                versions = [0] * len(part)
            else:
                part, versions = self._changed(part)
                history.add(events)
                found = self._anew(part)
            for r, f, v in zip(part, found, versions, strict=True):
                f["us"], f["transaction_id"], f["row"], f["version"] = r["us"], r["transaction_id"], r["row"], v
            out += found
            history.keep_rows([(r["us"], r["transaction_id"], v, r["row"]) for r, v in zip(part, versions, strict=True) if r["us"] >= watermark], watermark)
        self._tidy(watermark)
        return out

    def _parts(self, batch: list[dict]) -> Iterator[list[dict]]:
        """The batch, cut where the key has been idle for too long."""
        start = 0
        for k in range(1, len(batch)):
            if self.idle_us is not None and batch[k]["us"] - batch[k - 1]["us"] > self.idle_us:
                yield batch[start:k]
                start = k
        yield batch[start:]

    def _changed(self, part: list[dict]) -> tuple[list[dict], list[int]]:
        """The rows of the batch and the stored rows after its first, with their versions."""
        held = self.history.open_rows()
        own = {r["transaction_id"]: r for r in part}
        later = [(us, key, version, row) for us, key, version, row in held.values() if us > part[0]["us"] and key not in own]
        rows = [{"us": us, "transaction_id": key, "row": row, "_version": version + 1} for us, key, version, row in later]
        rows += [{**r, "_version": held[k][2] + 1 if k in held and held[k][3] == r["row"] else 0} for k, r in own.items()]
        rows.sort(key=lambda r: (r["us"], r["transaction_id"]))
        return rows, [r.pop("_version") for r in rows]

    def _tidy(self, watermark: int) -> None:
        history = self.history
        history.fold(watermark - history.horizon)
        if history.last is not None:
            history.wake(history.last[0] + (self._life() if history.totals else self.idle_us or self._life()))
        history.store()

    def _life(self) -> int:
        return self.history.horizon + HOUR_US

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        history, watermark = self.history, timerValues.getCurrentWatermarkInMs() * 1000
        history.load()
        history.timer = None
        if history.last is not None and self.idle_us is not None and watermark >= history.last[0] + self.idle_us:
            history.forget()
        elif history.last is not None:
            history.keep_rows([], watermark)
            history.fold(watermark - history.horizon)
            if not history.totals and not self.totals_matter:
                history.forget()
                return
            if history.totals or self.idle_us is not None:
                history.wake(max(history.last[0] + (self.idle_us or self._life()), watermark + HOUR_US))
            history.store()
        return
        yield

    def close(self) -> None:
        pass


class CustomerHistory(_Keyed):
    """Per customer: events of the last 30 days by the hour, totals of older ones, sights of each entity."""

    fields = EVENT_FIELDS

    def __init__(self, idle_days: int | None = None) -> None:
        if idle_days is not None and idle_days * DAY_US < HORIZON_US:
            raise ValueError(f"idle_days must reach over the longest window, {HORIZON_US // DAY_US} days")
        self.idle_us = None if idle_days is None else idle_days * DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = History(handle, [c for c, _ in DISTINCT_WINDOWS.values()], list(NOVELTY.values()), HORIZON_US)

    def _event(self, r: dict) -> list:
        place = [None if r[c] is None else float(r[c]) for c in ("lat", "lon")]
        return [r["us"], r["transaction_id"], int(r["cents"]), *place, *(r[c] for c in self.history.columns)]

    def _in_order(self, part: list[dict]) -> list[dict]:
        """Answers for rows later than all that is held."""
        history = self.history
        times, cents = [r["us"] for r in part], [int(r["cents"]) for r in part]
        sums, squares = [0, *accumulate(cents)], [0, *accumulate(c * c for c in cents)]
        held, held_squares = (history.older["n"] + history.sums[0][-1], history.older["cents"] + history.sums[1][-1]), history.squares()
        distinct = {n: Distinct(history, c, seconds) for n, (c, seconds) in DISTINCT_WINDOWS.items()}
        first: dict[tuple[str, str], int] = {}
        for r in part:
            for c in NOVELTY.values():
                first.setdefault((c, r[c] or ""), r["us"])

        def before(x: int) -> tuple[int, int]:
            if x <= times[0]:
                return history.before(x)
            k = bisect_left(times, x)
            return held[0] + k, held[1] + sums[k]

        out = []
        for us, same in groupby(part, key=lambda r: r["us"]):
            same, k = list(same), bisect_left(times, us)
            n, total = held[0] + k, held[1] + sums[k]
            edges = {s: before(us - s * SECOND) for s in WIDTHS}
            previous = [part[k - 1][c] for c in ("us", "transaction_id", "lat", "lon")] if k else history.last
            answer = _answer(n, total, held_squares + squares[k], previous, edges, {name: d.at(us) for name, d in distinct.items()})
            for r in same:
                news = {f"new_{name}": self._is_new(c, r[c], us, first) for name, c in NOVELTY.items()}
                out.append(answer | news)
            for name, d in distinct.items():
                for r in same:
                    d.add(r[DISTINCT_WINDOWS[name][0]], us)
        return out

    def _is_new(self, column: str, value: str | None, us: int, first: dict) -> int:
        return int(us <= first[column, value or ""] and self.history.first(column, value) is None)

    def _anew(self, part: list[dict]) -> list[dict]:
        """Answers for any rows that are held already, from all hours."""
        history = self.history
        events = history.all_events()
        times = [e[0] for e in events]
        sums, squares = [0, *accumulate(e[2] for e in events)], [0, *accumulate(e[2] ** 2 for e in events)]
        older = history.older
        column_at = {c: 5 + k for k, c in enumerate(history.columns)}
        by_id = {(e[0], e[1]): e for e in events}

        def before(x: int) -> tuple[int, int]:
            k = bisect_left(times, x)
            return older["n"] + k, older["cents"] + sums[k]

        spans = {name: _sliding(times, [e[column_at[c]] for e in events], sorted({r["us"] for r in part}), seconds * SECOND) for name, (c, seconds) in DISTINCT_WINDOWS.items()}
        out = []
        for r in part:
            us, k = r["us"], bisect_left(times, r["us"])
            n, total = before(us)
            edges = {s: before(us - s * SECOND) for s in WIDTHS}
            previous = [events[k - 1][j] for j in (0, 1, 3, 4)] if k else older["last"]
            event = by_id[us, r["transaction_id"]]
            news = {f"new_{name}": int(us <= history.first(c, event[column_at[c]])) for name, c in NOVELTY.items()}
            out.append(_answer(n, total, older["squares"] + squares[k], previous, edges, {name: d[us] for name, d in spans.items()}) | news)
        return out

    def _frame(self, key: str, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(out).assign(customer_id=key)[[f.name for f in STATS.fields]].astype({"prev_us": "Int64", "prev_lat": float, "prev_lon": float})


def _answer(n: int, total: int, squares: int, previous: list | None, edges: dict[int, tuple[int, int]], distinct: dict[str, int]) -> dict:
    """The statistics of one row: what lies before it, less what lies before its windows."""
    out = {"n_past": n, "cents_past": float(total), "std_cents": float(max(n * squares - total * total, 0)) ** 0.5 / n if n else None}
    out |= dict(zip(("prev_us", "prev_id", "prev_lat", "prev_lon"), previous or (None,) * 4, strict=True))
    out |= {f"n_{name}": n - edges[s][0] for name, s in COUNT_WINDOWS.items()}
    out |= {f"cents_{name}": total - edges[s][1] for name, s in SUM_WINDOWS.items()}
    return out | {f"d_{name}": v for name, v in distinct.items()}


def _sliding(times: list[int], values: list, at: list[int], width: int) -> dict[int, int]:
    """Distinct values of the events in [t - width, t) for each t, in order."""
    held: dict[Any, int] = {}
    low = high = 0
    out = {}
    for t in at:
        while high < len(times) and times[high] < t:
            held[values[high]] = held.get(values[high], 0) + 1
            high += 1
        while low < high and times[low] < t - width:
            held[values[low]] -= 1
            if not held[values[low]]:
                del held[values[low]]
            low += 1
        out[t] = len(held) - (None in held)
    return out


DEVICE_STATS = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("device_id", T.StringType()),
    T.StructField("device_customers", T.LongType()), T.StructField("version", T.LongType()), T.StructField("row", T.StringType()),
])


class DeviceCustomers(_Keyed):
    """Per device: customers of the last 24 hours. A device without an event for so long leaves no state."""

    fields = ["us", "transaction_id", "customer_id"]
    totals_matter = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = History(handle, ["customer_id"], [], DEVICE_WINDOW * SECOND)

    def _event(self, r: dict) -> list:
        return [r["us"], r["transaction_id"], 0, None, None, r["customer_id"]]

    def _in_order(self, part: list[dict]) -> list[dict]:
        distinct, out = Distinct(self.history, "customer_id", DEVICE_WINDOW), []
        for us, same in groupby(part, key=lambda r: r["us"]):
            same = list(same)
            out += [{"device_customers": n} for n in [distinct.at(us)] * len(same)]
            for r in same:
                distinct.add(r["customer_id"], us)
        return out

    def _anew(self, part: list[dict]) -> list[dict]:
        events = self.history.all_events()
        found = _sliding([e[0] for e in events], [e[5] for e in events], sorted({r["us"] for r in part}), DEVICE_WINDOW * SECOND)
        return [{"device_customers": found[r["us"]]} for r in part]

    def _frame(self, key: str, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(out).assign(device_id=key)[[f.name for f in DEVICE_STATS.fields]]


class Packed:
    """A processor's handle that keeps all states of a key in one entry, as long as that is short: one access reads them and one
    writes them. Values and map entries are single texts without separators (characters 30 and 31), map keys whole numbers."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.registerTimer, self.deleteTimer = handle.registerTimer, handle.deleteTimer  # noqa: N815
        self.entry = handle.getValueState("packed", "entries string")
        self.handle, self.maps = handle, {}
        self.held: dict[tuple[str, str], str] = {}
        self.limit = PACKED
        self.stored = self.own = False  #: whether the key has an entry, and whether its maps have entries of their own

    def getValueState(self, name: str, schema: str) -> PackedState:  # noqa: N802
        return PackedState(self, name, None)

    def getMapState(self, name: str, key: str, schema: str) -> PackedState:  # noqa: N802
        self.maps[name] = self.handle.getMapState(name, key, schema)
        return PackedState(self, name, self.maps[name])

    def begin(self) -> None:
        """Read what the current key has."""
        found = self.entry.get()
        self.stored, lines = bool(found), found[0].split("\x1e") if found and found[0] else []
        self.held = {(name, at): value for name, at, value in (line.split("\x1f", 2) for line in lines)}
        self.own = self.held.pop(("own", ""), None) is not None

    def end(self) -> None:
        if not self.held:  # forgotten
            if self.stored:
                self.entry.clear()
            return
        if not self.own and sum(map(len, self.held.values())) > self.limit:
            self.own = True
            for name, at in [k for k in self.held if k[0] in self.maps]:
                self.maps[name].updateValue((int(at),), (self.held.pop((name, at)),))
        lines = [f"{name}\x1f{at}\x1f{value}" for (name, at), value in self.held.items()]
        self.entry.update(("\x1e".join([*lines, "own\x1f\x1f"] if self.own else lines),))


class PackedState:
    """A value or a map of ``Packed``."""

    def __init__(self, pack: Packed, name: str, own: Any) -> None:
        self.pack, self.name, self.own = pack, name, own

    def get(self) -> tuple | None:
        found = self.pack.held.get((self.name, ""))
        return None if found is None else (found,)

    def update(self, value: tuple) -> None:
        self.pack.held[self.name, ""] = value[0]

    def getValue(self, key: tuple) -> tuple | None:  # noqa: N802
        return self.own.getValue(key) if self.pack.own else (self.pack.held[self.name, str(key[0])],)

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        if self.pack.own:
            self.own.updateValue(key, value)
        else:
            self.pack.held[self.name, str(key[0])] = value[0]

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        if self.pack.own:
            self.own.removeKey(key)
        else:
            self.pack.held.pop((self.name, str(key[0])), None)

    def clear(self) -> None:
        if self.own is not None and self.pack.own:
            self.own.clear()
        self.pack.held = {k: v for k, v in self.pack.held.items() if k[0] != self.name}


class ByRow(StatefulProcessor):
    """Runs a keyed processor on rows, as with many small keys a table for each costs more than its rows do. Each cell and each
    row that passes between Spark and Python costs as well: an event comes as JSON, and answers leave together (see ``_answers``)."""

    def __init__(self, keyed: _Keyed, schema: T.StructType) -> None:
        self.keyed, self.fields = keyed, {k: itemgetter(*names, names[0]) for k, names in _by_kind(schema).items()}  # a tuple for one name as well

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pack = Packed(handle)
        self.keyed.init(self.pack)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        blank, batch = dict.fromkeys(self.keyed.fields), []
        for r in rows:
            event, row = r[-1].split("\t", 1)
            batch.append({**blank, **json.loads(event), "row": row})
        batch.sort(key=lambda r: (r["us"], r["transaction_id"], r["sent"]))
        self.pack.begin()
        made, found = Row("answers"), self.keyed.answers(batch, timerValues)
        self.pack.end()
        for start in range(0, len(found), ANSWERS):
            part = found[start : start + ANSWERS]
            yield made(_lines([{k: take(a) for k, take in self.fields.items()} for a in part], [a["row"] for a in part]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.pack.begin()
        yield from self.keyed.handleExpiredTimer(key, timerValues, expiredTimerInfo)
        self.pack.end()

    def close(self) -> None:
        self.keyed.close()


def _by_kind(schema: T.StructType) -> dict[str, list[str]]:
    """Names of an answer's whole numbers (and truth values), of its numbers and of its texts."""
    kinds = {T.LongType: "n", T.BooleanType: "n", T.DoubleType: "x", T.StringType: "t"}
    found = {k: [f.name for f in schema.fields if kinds[type(f.dataType)] == k and f.name != "row"] for k in "nxt"}
    return {k: names for k, names in found.items() if names}


def _answers(events: DataFrame, key: str, sent: Column, processor: _Keyed, schema: T.StructType) -> DataFrame:
    """What the processor answers to the events of each key. Events need ``key``, ``timestamp``, ``row`` and the processor's fields;
    ``schema`` has what is taken of an answer."""
    # One cell, as each is read by itself: the event, and after a tab the row, which is only handed on.
    event = F.concat(F.to_json(F.struct(*processor.fields, sent.alias("sent"))), F.lit("\t"), "row")
    found = events.select(key, "timestamp", event.alias("event")).groupBy(key).transformWithState(
        statefulProcessor=ByRow(processor, schema), outputStructType=T.StructType([T.StructField("answers", T.StringType())]), outputMode="Append", timeMode="EventTime")
    lines = found.select(F.split("answers", "\n").alias("lines"))
    about = F.from_json(F.col("lines")[0], "array<struct<n: array<bigint>, x: array<double>, t: array<string>>>")
    each = lines.select(F.explode(F.arrays_zip(about.alias("a"), F.slice("lines", F.lit(2), F.size("lines") - 1).alias("row"))).alias("e")).select("e.*")
    place = {n: F.get(F.col(f"a.{k}"), F.lit(i)) for k, names in _by_kind(schema).items() for i, n in enumerate(names)} | {"row": F.col("row")}
    return each.select(*[place[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def stream_customer_features(events: DataFrame, idle_days: int | None = None) -> DataFrame:
    """Customer history statistics of a stream of transactions, finished into the named features, with ``version``.

    The stream needs a watermark on ``timestamp``, as ``dedupe_stream`` sets it.
    """
    from riskloom.operators.history import RAW_STATS, finish_history

    schema = T.StructType([f for f in events.schema.fields])
    shaped = events.withColumns({"us": micros(F.col("timestamp")), "cents": (F.col("amount") * 100).cast("long")})
    keyed = shaped.select("customer_id", "timestamp", *EVENT_FIELDS, F.to_json(F.struct(*events.columns), JSON).alias("row"))
    stats = _answers(keyed, "customer_id", F.lit(0), CustomerHistory(idle_days), T.StructType([f for f in STATS.fields if f.name != "customer_id"]))
    known = F.struct(F.col("prev_us").alias("us"), F.col("prev_id").alias("transaction_id"), F.col("prev_lat").alias("lat"), F.col("prev_lon").alias("lon"))
    rest = [c for c in stats.columns if c not in ("row", "transaction_id", "customer_id") and not c.startswith("prev_")]
    opened = stats.select(
        F.from_json("row", schema, JSON).alias("r"), *rest,
        F.when(F.col("prev_us").isNotNull(), known).alias("previous")).select("r.*", *rest, "previous")
    finished = finish_history(opened.withColumn("cents", (F.col("amount") * 100).cast("long")))
    return finished.drop(*RAW_STATS, "cents_past", "us")


def stream_device_features(events: DataFrame) -> DataFrame:
    """Adds device_customer_count and device_version to a stream with a watermark on ``timestamp``; keeps every other column.

    Rows without a device share one key, as in batch.
    """
    schema = T.StructType([f for f in events.schema.fields])
    sent = F.col("version") if "version" in events.columns else F.lit(0).cast("long")
    keyed = events.select(F.coalesce("device_id", F.lit("")).alias("device_id"), "timestamp", "transaction_id", "customer_id", sent.alias("sent"), micros(F.col("timestamp")).alias("us"), F.to_json(F.struct(*events.columns), JSON).alias("row"))
    stats = _answers(keyed, "device_id", F.col("sent"), DeviceCustomers(), T.StructType([f for f in DEVICE_STATS.fields if f.name != "device_id"]))
    count = F.greatest(F.lit(1), F.col("device_customers")).alias("device_customer_count")
    return stats.select(F.from_json("row", schema, JSON).alias("r"), count, F.col("version").alias("device_version")).select("r.*", "device_customer_count", "device_version")


def latest_rows(rows: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Of each transaction the row of the highest version. Rows that late ones have changed are stored again."""
    versions = [c for c in ("version", "device_version") if c in rows.columns]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*versions)).alias("r"))
    return best.select("r.*")
