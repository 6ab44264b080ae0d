"""Machines for streams of the operators that batch runs express as windows.

Non-time windows cannot run on streams, so each of these keeps the little
that the next event needs. They give what the functions of the same name in
:mod:`deltaloom.operators` give. Events are dicts with the columns of the
stream. Selectors are names of columns or functions of an event, predicates
functions, columns that must be true, or (column, value) pairs. Neither is
part of a machine's state (``settings``), so any function will do on a stream
as well.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import Any

from deltaloom.operators.stateful import Machine

Selector = str | Callable[[dict], Any]
_NONE = object()


def pick(selector: Selector) -> Callable[[dict], Any]:
    """A selector as a function of an event."""
    return selector if callable(selector) else lambda e: e[selector]


def meets(predicate: str | tuple[str, Any] | Callable[[dict], bool]) -> Callable[[dict], bool]:
    """A predicate as a function of an event; null is not true."""
    if isinstance(predicate, tuple):
        return lambda e: e[predicate[0]] == predicate[1]
    return predicate if callable(predicate) else lambda e: bool(e[predicate])


def lifetime(e: dict, default: int | None) -> int | None:
    """How long an event lives in µs: its own ``ttl`` in ms if it has one, else the default."""
    own = e.get("ttl")
    return default if own is None or own != own else int(own * 1000)


class Changed(Machine):
    """Events whose value differs from the one before; the first passes unless it equals ``initial``."""

    settings = ("selector",)

    def __init__(self, selector: Selector, initial: Any = _NONE) -> None:
        self.selector, self.value, self.fresh = pick(selector), None if initial is _NONE else initial, initial is _NONE

    def push(self, t, e):
        v = self.selector(e)
        passes, self.value, self.fresh = self.fresh or v != self.value, v, False
        return [(t, e)] if passes else []


class SampleCount(Machine):
    """Every n-th event."""

    def __init__(self, n: int) -> None:
        self.n, self.seen = n, 0

    def push(self, t, e):
        self.seen += 1
        return [(t, e)] if self.seen % self.n == 0 else []


class GroupCount(Machine):
    """Lists of n events."""

    def __init__(self, n: int) -> None:
        self.n, self.events = n, []

    def push(self, t, e):
        self.events.append(e)
        if len(self.events) < self.n:
            return []
        out, self.events = self.events, []
        return [(t, out)]


class ContextTime(Machine):
    """For each event the list of those before it, at most ``us`` old, without itself."""

    def __init__(self, us: int) -> None:
        self.us, self.recent = us, deque()

    def push(self, t, e):
        while self.recent and t - self.recent[0][0] > self.us:
            self.recent.popleft()
        out = [x for _, x in self.recent]
        self.recent.append((t, e))
        return [(t, out)]


class ContextCount(Machine):
    """For each event the list of the last n, itself included."""

    def __init__(self, n: int) -> None:
        self.recent = deque(maxlen=n)

    def push(self, t, e):
        self.recent.append(e)
        return [(t, list(self.recent))]


class Settle(Machine):
    """The last event before a silence of ``us``."""

    def __init__(self, us: int) -> None:
        self.us, self.last = us, None

    def push(self, t, e):
        self.last, self.due = e, t + self.us
        return []

    def fire(self, d):
        self.due = None
        return [(d, self.last)]


class Stable(Machine):
    """Events at most ``us`` after one of the same value."""

    settings = ("selector",)

    def __init__(self, us: int, selector: Selector) -> None:
        self.us, self.selector, self.time, self.value = us, pick(selector), None, None

    def push(self, t, e):
        v = self.selector(e)
        calm = self.time is not None and t - self.time <= self.us and v == self.value
        self.time, self.value = t, v
        return [(t, e)] if calm else []


class Ddt(Machine):
    """Change of the value a millisecond, as ``metric``."""

    settings = ("selector",)

    def __init__(self, selector: Selector) -> None:
        self.selector, self.time, self.value = pick(selector), None, None

    def push(self, t, e):
        v = self.selector(e)
        dv, dt = (0, 0) if self.time is None else (v - self.value, (t - self.time) / 1000)
        self.time, self.value = t, v
        return [(t, e | {"metric": dv / dt if dv and dt else 0.0})]


class Coalesce(Machine):
    """Every ``us`` the latest event of each key, expired ones once and for the last time; none comes in expired.

    The time to live is the event's own ``ttl`` in ms, else ``ttl_us``.
    """

    settings = ("selector",)

    def __init__(self, selector: Selector, us: int = 1_000_000, ttl_us: int = 60_000_000) -> None:
        self.selector, self.us, self.ttl_us, self.lake = pick(selector), us, ttl_us, {}

    def push(self, t, e):
        if e.get("state") == "expired":
            return []
        self.lake[self.selector(e)] = (t, e)
        if self.due is None:
            self.due = t + self.us
        return []

    def fire(self, d):
        out = []
        for k, (t, e) in list(self.lake.items()):
            over = t + lifetime(e, self.ttl_us) < d
            out.append(e | {"state": "expired"} if over else e)
            if over:
                del self.lake[k]
        self.due = d + self.us if out else None
        return [(d, out)] if out else []

    def all(self) -> dict[Any, dict]:
        """The latest event of each key at present."""
        return {k: e for k, (_, e) in self.lake.items()}


class Project(Machine):
    """For each event the list of the latest to meet each predicate, as long as its time to live lasts: its own ``ttl`` in ms, else ``ttl_us``."""

    settings = ("predicates",)

    def __init__(self, predicates: list[str | tuple[str, Any] | Callable[[dict], bool]], ttl_us: int | None) -> None:
        self.predicates, self.ttl_us, self.slots = [meets(p) for p in predicates], ttl_us, [None] * len(predicates)

    def push(self, t, e):
        self.slots = [(t, e) if p(e) else s for p, s in zip(self.predicates, self.slots, strict=True)]
        out = [s and s[1] for s in self.slots]
        self.slots = [s if s and (ttl := lifetime(s[1], self.ttl_us)) is not None and s[0] + ttl >= t else None for s in self.slots]
        return [(t, out)]


class Fillin(Machine):
    """All events, and the last again every ``us`` of silence within its time to live, with ``filled``: its own ``ttl`` in ms, else ``ttl_us``."""

    settings = ("generate",)

    def __init__(self, us: int, ttl_us: int = 60_000_000, generate: Callable[[dict], dict] | None = None) -> None:
        self.us, self.ttl_us, self.generate, self.last, self.end = us, ttl_us, generate, None, 0

    def push(self, t, e):
        self.last, self.end, self.due = e, t + lifetime(e, self.ttl_us), t + self.us
        return [(t, e | {"filled": False})]

    def fire(self, d):
        self.due = d + self.us
        if self.end < d:
            self.due = None
            return []
        return [(d, (self.generate(self.last) if self.generate else self.last) | {"filled": True})]
