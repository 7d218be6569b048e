"""Rate limiters, circuit breakers and caches replayed over tables of events.

Rules that look at each event in turn run over rows sorted by key and time. Rows stream
through in batches and only a key's state is kept, so a key of any length fits.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(events: DataFrame, key: str, order: list[str], carried: list[str], machine: Callable[[], Callable], schema: str) -> DataFrame:
    """Feed each key's rows, in order, to a machine of its own.

    ``machine()`` gives a function that takes the ``order`` and ``carried`` values of a row
    and returns the values of the columns that ``schema`` adds to them.
    """
    cols = [key, *order, *(c for c in carried if c not in order)]
    added = [x.split()[0] for x in schema.split(", ")]
    types = dict(events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != at:
                    at, step = row[0], machine()
                out.append(step(*row[1:]))
            yield pd.concat([batch, pd.DataFrame(out, columns=added, index=batch.index)], axis=1)

    rows = events.filter(F.col(key).isNotNull()).select(*cols).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInPandas(run, ", ".join([f"`{c}` {types[c]}" for c in cols] + [schema]))


# Rate limits ---------------------------------------------------------------------

LIMIT = "allowed boolean, remaining long"


def fixed_window(limit: int, window_ms: int):
    """A window begins with the first call after the last one is over."""

    def machine():
        began, used = None, 0

        def step(now: int, *_):
            nonlocal began, used
            if began is None or now >= began + window_ms:
                began, used = now, 0
            if used >= limit:
                return False, 0
            used += 1
            return True, limit - used

        return step

    return machine


def sliding_window(limit: int, window_ms: int):
    """Allowed calls of the last ``window_ms`` count; denied ones don't."""

    def machine():
        calls: deque = deque()

        def step(now: int, *_):
            while calls and calls[0] <= now - window_ms:
                calls.popleft()
            if len(calls) >= limit:
                return False, 0
            calls.append(now)
            return True, limit - len(calls)

        return step

    return machine


def token_bucket(capacity: float, per_second: float):
    """A bucket that fills by ``per_second`` up to its capacity; a call takes one."""

    def machine():
        tokens, last = float(capacity), None

        def step(now: int, *_):
            nonlocal tokens, last
            tokens = min(capacity, tokens + (0 if last is None else (now - last) / 1000 * per_second))
            last = now
            if tokens < 1:
                return False, 0
            tokens -= 1
            return True, int(tokens)

        return step

    return machine


def limiter(algorithm: str = "sliding-window", limit: int = 100, window_ms: int = 60_000, capacity: float | None = None, refill: float | None = None):
    if algorithm == "fixed-window":
        return fixed_window(limit, window_ms)
    if algorithm == "token-bucket":
        return token_bucket(limit if capacity is None else capacity, limit / (window_ms / 1000) if refill is None else refill)
    if algorithm == "sliding-window":
        return sliding_window(limit, window_ms)
    raise ValueError(f"unknown algorithm: {algorithm}")


def rate_limit(calls: DataFrame, key: str, time_ms: str, tie: str, **options) -> DataFrame:
    """Which calls a limiter lets through: adds allowed and remaining."""
    return replay(calls, key, [time_ms, tie], [], limiter(**options), LIMIT)


# Circuit breaker ------------------------------------------------------------------


def breaker(failures: int = 5, rate: float = 0.5, successes: int = 2, reset_ms: int = 60_000, timeout_ms: float = 30_000, minimum: int = 10):
    """Closed, open or half open by what calls came to.

    Opens after ``failures`` in a row, or once at least ``minimum`` calls of its life failed
    at ``rate``. Open, it rejects until ``reset_ms`` are over and then lets calls try;
    ``successes`` in a row close it. Its lifetime counts are never reset. A call longer than
    ``timeout_ms`` is a failure.
    """

    def machine():
        state, in_row, good, total, failed, until = "closed", 0, 0, 0, 0, 0

        def step(now: int, _tie, success: bool, duration: float):
            nonlocal state, in_row, good, total, failed, until
            if state == "open":
                if now < until:
                    return "rejected", state
                state, good = "half_open", 0
            total += 1
            if success and not duration > timeout_ms:
                in_row = 0
                if state == "half_open":
                    good += 1
                    if good >= successes:
                        state, good = "closed", 0
                return "success", state
            failed, in_row, good = failed + 1, in_row + 1, 0
            if in_row >= failures or total >= minimum and failed / total >= rate:
                state, until = "open", now + reset_ms
            return "failure", state

        return step

    machine.reset_ms = reset_ms
    return machine


def circuit_breaker(calls: DataFrame, key: str, time_ms: str, tie: str, success: str, duration: str, **options) -> DataFrame:
    """Adds outcome (success, failure, rejected) and the breaker's state after each call."""
    return replay(calls, key, [time_ms, tie], [success, duration], breaker(**options), "outcome string, state string")


# Cache ------------------------------------------------------------------------------


def lru_cache(size: int = 1000, ttl_ms: int = 3_600_000, by_expiry: bool = False):
    """A cache with a time to live; full, it drops what was used, or expires, first."""

    def machine():
        held: OrderedDict = OrderedDict()  # key: expiry, the least recently used first

        def step(now: int, _tie, item):
            expiry = held.get(item)
            if expiry is not None and now <= expiry:
                held.move_to_end(item)
                return True, len(held)
            held.pop(item, None)
            if len(held) >= size:
                held.pop(min(held, key=held.get) if by_expiry else next(iter(held)))
            held[item] = now + ttl_ms
            return False, len(held)

        return step

    return machine


def cache_replay(accesses: DataFrame, key: str, time_ms: str, tie: str, item: str, **options) -> DataFrame:
    """Adds hit and how many entries the cache of each key holds afterwards."""
    return replay(accesses, key, [time_ms, tie], [item], lru_cache(**options), "hit boolean, entries long")


