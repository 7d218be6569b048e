"""Driver-side helpers: errors with codes, retries, and a record of operations that becomes a table."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


class DocumentError(Exception):
    """Any error of document processing; ``code`` tells which."""

    code = "DOCUMENT_ERROR"

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = context


class UnsupportedFormatError(DocumentError):
    code = "UNSUPPORTED_FORMAT"


class FileTooLargeError(DocumentError):
    code = "FILE_TOO_LARGE"


class ConfigValidationError(DocumentError):
    code = "CONFIG_VALIDATION_ERROR"


class RateLimitError(DocumentError):
    code = "RATE_LIMIT_ERROR"


class CircuitBreakerError(DocumentError):
    code = "CIRCUIT_BREAKER_ERROR"


class DocumentValidationError(DocumentError):
    code = "DOCUMENT_VALIDATION_ERROR"


class DocumentLoadError(DocumentError):
    code = "DOCUMENT_LOAD_ERROR"


def retry(run: Callable, attempts: int = 3, delay: float = 1.0, exponential: bool = True, retry_if: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """``run()`` up to ``attempts`` times, for work on the driver; tasks are retried by Spark itself."""
    for k in range(attempts):
        try:
            return run()
        except Exception as e:
            if k + 1 >= attempts or not retry_if(e):
                raise DocumentLoadError(f"gave up after {k + 1} attempts: {e}", attempts=k + 1) from e
            sleep(delay * (2**k if exponential else 1))
    raise ConfigValidationError("at least one attempt is needed")


def or_default(run: Callable, default=None, rethrow: bool = False):
    """The result, or ``default`` if ``run()`` fails."""
    try:
        return run()
    except Exception:
        if rethrow:
            raise
        return default


def _now_ms() -> int:
    return int(time.time() * 1000)


def limited(run: Callable, machine: Callable, key: Callable = lambda *a, **k: None, clock: Callable[[], int] = _now_ms) -> Callable:
    """``run`` behind a limiter of operators.state, one for each key of its arguments; a call over the limit is an error."""
    steps: dict = {}

    def call(*args, **kwargs):
        k = key(*args, **kwargs)
        if k not in steps:
            steps[k] = machine()
        if not steps[k](clock())[0]:
            raise RateLimitError(f"too many calls: {k}")
        return run(*args, **kwargs)

    return call


def guarded(run: Callable, machine: Callable, fallback: Callable | None = None, clock: Callable[[], int] = _now_ms) -> Callable:
    """``run`` behind a circuit breaker of operators.state; while it is open, the fallback or an error."""
    step, reopens = machine(), 0

    def call(*args, **kwargs):
        nonlocal reopens
        began = clock()
        if began < reopens:
            if fallback:
                return fallback(*args, **kwargs)
            raise CircuitBreakerError("the circuit is open")
        try:
            out, ok = run(*args, **kwargs), True
            return out
        except Exception:
            ok = False
            raise
        finally:
            ended = clock()
            state = step(ended, None, ok, ended - began)[1]
            reopens = ended + machine.reset_ms if state == "open" else 0

    return call


OPERATIONS = "operation string, started timestamp, ended timestamp, duration double, success boolean, error string"


@dataclass
class Recorder:
    """Operations of this driver, to be analysed as a table by operators.metrics."""

    rows: list[tuple] = field(default_factory=list)

    @contextmanager
    def operation(self, name: str):
        began = datetime.now(timezone.utc)
        error = None
        try:
            yield
        except Exception as e:
            error = str(e)
            raise
        finally:
            ended = datetime.now(timezone.utc)
            self.rows.append((name, began, ended, (ended - began).total_seconds() * 1000, error is None, error))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, OPERATIONS)


@dataclass(frozen=True)
class Options:
    """Settings of the service, checked when they are made."""

    max_file_size: int = 100 * 1024 * 1024
    strict_mime: bool = False
    cache: bool = False
    cache_ttl_seconds: int = 3600
    continue_on_error: bool = True
    detect_scanned: bool = True
    rate_limit: int | None = None
    rate_window_ms: int = 60_000

    def __post_init__(self):
        bad = [f.name for f in fields(self) if isinstance(v := getattr(self, f.name), int) and not isinstance(v, bool) and v <= 0]
        if bad:
            raise ConfigValidationError(f"must be positive: {', '.join(bad)}")
