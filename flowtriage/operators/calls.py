"""One call to a classifier: clock, pace and retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

# (model_name, model_id, provider, prompt and what other columns a request has) -> HTTP status and response body
Scorer = Callable[[dict], tuple[int, str]]


class Clock:
    """The time, and waiting. Another one takes its place where time must not pass, or must be known."""

    def now(self) -> float:
        return time.time()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class CountedClock(Clock):
    """A time that begins at zero and passes by waiting only."""

    def __init__(self):
        self.seconds = 0.0

    def now(self) -> float:
        return self.seconds

    def sleep(self, seconds: float) -> None:
        self.seconds += seconds


class Pace:
    """Starts of calls, `interval` seconds apart at least."""

    def __init__(self, interval: float, clock: Clock):
        self.interval, self.clock, self.next = interval, clock, clock.now()

    def wait(self) -> None:
        early = self.next - self.clock.now()
        if early > 0:
            self.clock.sleep(early)
        self.next = max(self.next, self.clock.now()) + self.interval


@dataclass(frozen=True)
class RetryPolicy:
    """Tries, seconds before the first retry, random extra, statuses to wait out.

    Exceptions of the named types are failures of the connection; the usual HTTP clients derive theirs from OSError.
    """

    max_tries: int = 5
    base_delay: float = 2.0
    jitter: float = 0.5
    statuses: tuple[int, ...] = (429, 500, 502, 503, 504)
    exceptions: tuple[type[Exception], ...] = (OSError,)

    def delay(self, attempt: int, uniform: Callable[[float, float], float] = random.uniform) -> float:
        return self.base_delay * 2 ** (attempt - 1) + uniform(0, self.jitter)


def call_with_retries(
    scorer: Scorer, request: dict, policy: RetryPolicy, sleep: Callable[[float], None] = time.sleep
) -> str:
    """The response body, or the last failure as an exception.

    A busy provider (policy.statuses) is waited for after every try; other
    refusals, time-outs and lost connections fail at the last try.
    """
    failure: Exception | None = None
    for attempt in range(1, policy.max_tries + 1):
        try:
            status, body = scorer(request)
        except policy.exceptions as exc:
            failure = exc
        else:
            if status < 400:
                return body
            failure = RuntimeError(f"HTTP {status}: {body[:300]}")
            if status in policy.statuses:
                sleep(policy.delay(attempt))
                continue
        if attempt < policy.max_tries:
            sleep(policy.delay(attempt))
    raise RuntimeError(f"call failed after {policy.max_tries} tries: {failure}")

