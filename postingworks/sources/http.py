"""Polite HTTP for board readers: a token bucket per host, retries with full jitter, typed failures.

All of it runs inside one reader task per host, so a host is never asked from two executors at once, and a retry never
repeats more than one request. Clock, sleep and randomness are parameters.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit

from ..config import Settings


class UpstreamError(Exception):
    """A failed request; status None means no response came."""

    def __init__(self, message: str, status: int | None = None, retry_after_s: int | None = None):
        super().__init__(message)
        self.status, self.retry_after_s = status, retry_after_s

    @property
    def retryable(self) -> bool:
        return self.status is None or self.status == 429 or self.status >= 500


class NotFound(UpstreamError):
    pass


class TokenBucket:
    """Reservations at a steady rate with a burst; acquire() sleeps until its token is due."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or burst < 1:
            raise ValueError("rate and burst must be positive")
        self._rate, self._burst, self._clock, self._sleep = rate, burst, clock, sleep
        self._tokens, self._at = float(burst), clock()

    def acquire(self) -> float:
        now = self._clock()
        self._tokens = min(self._burst, self._tokens + (now - self._at) * self._rate)
        self._at = now
        self._tokens -= 1
        wait = max(0.0, -self._tokens / self._rate)
        if wait:
            self._sleep(wait)
        return wait


class Retry:
    """Up to max_attempts; waits a random time below min(max_delay, base * 2^(n-1)), or what the server asked for."""

    def __init__(self, settings: Settings = Settings(), sleep: Callable[[float], None] = time.sleep, draw: Callable[[float], float] = lambda top: random.uniform(0, top)):
        self._s, self._sleep, self._draw, self.retries = settings, sleep, draw, 0

    def run(self, action: Callable[[], bytes]) -> bytes:
        for attempt in range(1, self._s.max_attempts + 1):
            try:
                return action()
            except UpstreamError as e:
                asked = e.retry_after_s
                if not e.retryable or attempt == self._s.max_attempts or (asked or 0) > self._s.max_retry_after_s:
                    raise
                top = min(self._s.max_delay_ms, self._s.base_delay_ms * 2 ** (attempt - 1)) / 1000
                self.retries += 1
                self._sleep(asked if asked is not None else self._draw(top))
        raise AssertionError("unreachable")


def open_url(url: str, body: str | None, settings: Settings) -> bytes:
    request = urllib.request.Request(url, body.encode() if body is not None else None, {"Accept": "application/json", **({"Content-Type": "application/json"} if body is not None else {})})
    try:
        with urllib.request.urlopen(request, timeout=settings.request_timeout_s) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After", "") if e.headers else ""
        kind = NotFound if e.code == 404 else UpstreamError
        raise kind(f"{url}: HTTP {e.code}", e.code, int(after) if after.strip().isdigit() else None) from e
    except OSError as e:
        raise UpstreamError(f"{url}: {e}") from e


class Fetcher:
    """GET and POST with both rules; buckets are keyed by host and port."""

    def __init__(self, settings: Settings = Settings(), send: Callable[[str, str | None, Settings], bytes] = open_url, retry: Retry | None = None, sleep: Callable[[float], None] = time.sleep):
        self._settings, self._send, self._retry, self._sleep = settings, send, retry or Retry(settings, sleep), sleep
        self._buckets: dict[str, TokenBucket] = {}

    @property
    def retries(self) -> int:
        """Attempts that were repeated so far."""
        return self._retry.retries

    def fetch(self, url: str, body: str | None = None) -> str:
        at = urlsplit(url)
        key = f"{at.hostname}:{at.port or (443 if at.scheme == 'https' else 80)}"
        bucket = self._buckets.setdefault(key, TokenBucket(self._settings.requests_per_second, self._settings.burst, sleep=self._sleep))

        def once() -> bytes:
            bucket.acquire()
            return self._send(url, body, self._settings)

        return self._retry.run(once).decode("utf-8")
