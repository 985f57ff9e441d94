"""Point-in-time timelines of a company in one sweep over its filings, in order of the filing date.

The sweep carries what is known so far, period ends and the last filed value of every (concept, end),
and writes a row per filing date.  It replaces a separate as-of merge per question.  Dates are days as
integers here; ``facts`` turns them back and computes the ratios.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa

EVENT_COLUMNS = [
    "entity", "concept", "kind", "priority", "start", "end", "filed", "accn", "value",
]
ANNUAL_VALUES = {
    "rev": ("Revenue", 0), "rev0": ("Revenue", 1), "ni": ("Net Income", 0), "cfo": ("Operating Cash Flow", 0),
    "assets": ("Assets", 0), "assets0": ("Assets", 1), "equity": ("Equity", 0), "sh": ("Diluted Shares", 0),
    "sh0": ("Diluted Shares", 1),
}
QUARTER_VALUES = {
    "rev": ("Revenue", 0), "rev0": ("Revenue", 1), "ni": ("Net Income", 0), "ni0": ("Net Income", 1),
    "sh": ("Diluted Shares", 0), "sh0": ("Diluted Shares", 1), "assets": ("Assets", 0), "assets0": ("Assets", 1),
    "equity": ("Equity", 0),
}


class Ends:
    """Distinct period ends in order."""

    def __init__(self):
        self.sorted: list[int] = []
        self.seen: set[int] = set()

    def add(self, end: int) -> bool:
        """Whether the end is new."""
        if end in self.seen:
            return False
        self.seen.add(end)
        insort(self.sorted, end)
        return True

    def year_before(self, end: int) -> int | None:
        """The end 330 to 400 days earlier that is closest to 365; of two the earlier."""
        near = self.sorted[bisect_left(self.sorted, end - 400) : bisect_right(self.sorted, end - 330)]
        return min(near, key=lambda e: (abs(end - e - 365), e), default=None)


def _text(value) -> tuple[bool, str]:
    """Missing texts come first, as in Spark's order."""
    return (value is not None, value or "")


def _column(values: pa.Array) -> list:
    """By way of numpy where nothing is missing, which is several times faster."""
    return values.to_pylist() if values.null_count else values.to_numpy(zero_copy_only=False).tolist()


def _days(events: list[tuple]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Filing dates in order, each with its events."""
    return groupby(events, key=itemgetter(EVENT_COLUMNS.index("filed")))


def _lookups(wanted: dict[str, tuple[str, int]]) -> tuple[dict[str, dict], list[tuple[dict, int]]]:
    """Values by concept and end, none yet, and for each wanted one where it is and of which end."""
    values = {concept: {} for concept, _ in wanted.values()}
    return values, [(values[concept], which) for concept, which in wanted.values()]


def annual_rows(events: list[tuple]) -> list[tuple]:
    """(entity, filed, current_end, previous_end, values): dates on which the two latest ends of assets
    known are a year apart."""
    (values, lookups), ends, out = _lookups(ANNUAL_VALUES), [], []
    for filed, day in _days(events):
        best, entity = {}, None
        for name, concept, _, priority, _, end, _, accn, value in day:
            if name and (entity is None or name > entity):
                entity = name
            key, found = (concept, end), (priority, _text(accn), value)
            if key not in best or found < best[key]:
                best[key] = found
            if concept == "Assets" and end not in ends:
                insort(ends, end)
                del ends[:-2]
        for (concept, end), found in best.items():
            values[concept][end] = found[-1]
        if len(ends) == 2 and 300 <= ends[1] - ends[0] <= 430:
            two = (ends[1], ends[0])
            out.append((entity, filed, *two, *[found.get(two[which]) for found, which in lookups]))
    return out


def _fourth_quarter(nine: dict, start: int, end: int) -> tuple | None:
    """The nine-month value that an annual value contains: last filed, preferred tag, last span."""
    fit = (
        (filed, -found[0], end9, start9, found[-1])
        for (start9, end9), (filed, found) in nine.items()
        if abs(start9 - start) <= 15 and 60 <= end - end9 <= 120
    )
    return max(fit, key=itemgetter(0, 1, 2, 3), default=None)


def quarterly_rows(events: list[tuple]) -> list[tuple]:
    """(entity, filed, current_end, prior_end, values): dates with a quarter or balance value, once a
    quarter and an end a year before the latest one are known."""
    (values, lookups), known, out = _lookups(QUARTER_VALUES), Ends(), []
    latest = prior = None
    nine: dict[str, dict] = {}
    for filed, day in _days(events):
        day = list(day)
        today = {}
        for _, concept, kind, priority, start, end, _, accn, value in day:
            if kind == "nine_month" and concept != "Diluted Shares":
                key, found = (concept, start, end), (priority, _text(accn), value)
                if key not in today or found < today[key]:
                    today[key] = found
        for (concept, start, end), found in today.items():
            nine.setdefault(concept, {})[start, end] = (filed, found)
        best, balances, moved = {}, [], False
        for name, concept, kind, priority, start, end, _, accn, value in day:
            if kind == "nine_month":
                continue
            derived = 0
            if kind == "annual":
                whole = None if concept == "Diluted Shares" else _fourth_quarter(nine.get(concept, {}), start, end)
                if whole is None:
                    continue
                derived, value = 1, value - whole[-1]
            elif kind == "instant":
                balances.append(name)
            key, found = (concept, end), (derived, priority, _text(accn), value, _text(name))
            if key not in best or found < best[key]:
                best[key] = found
                if kind != "instant" and (latest is None or end > latest):
                    latest, moved = end, True
            moved = known.add(end) or moved
        if not best:
            continue
        names = [found[-1][1] for found in best.values() if found[-1][0]]
        entity = max([*names, *filter(None, balances)], default=None)
        for (concept, end), found in best.items():
            values[concept][end] = found[3]
        if moved and latest is not None:
            prior = known.year_before(latest)
        if prior is not None:
            two = (latest, prior)
            out.append((entity, filed, *two, *[ends.get(two[which]) for ends, which in lookups]))
    return out


def company_sweep(
    rows: Callable[[list[tuple]], list[tuple]], wanted: dict
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` for every company of a task's events, which come by company and filing date.

    Many companies share a batch; the last company of a batch waits for the next one.
    """
    days = pa.int32()
    types = {"cik": pa.int64(), "entity": pa.string(), "as_of": days, "current_end": days, "previous_end": days}
    types |= {name: pa.float64() for name in wanted}

    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [[]] * len(types)
        return pa.record_batch({n: pa.array(c, t, from_pandas=True) for (n, t), c in zip(types.items(), columns)})

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cik, events = None, []
        for batch in batches:
            found = []
            every = zip(_column(batch["cik"]), zip(*[_column(batch[c]) for c in EVENT_COLUMNS]))
            for key, company in groupby(every, key=itemgetter(0)):
                if key != cik:
                    found += [(cik, *row) for row in rows(events)]
                    cik, events = key, []
                events += map(itemgetter(1), company)
            yield made(found)
        yield made([(cik, *row) for row in rows(events)])

    return sweep
