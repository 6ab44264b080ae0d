"""Listeners by name, for callers that want to be told of changes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Hub:
    """Calls every listener of a name, in the order in which they came; a name without any goes to those for unhandled names. ``initial`` names the first listeners."""

    def __init__(self, initial: dict[str, Callable] | None = None) -> None:
        self.listeners: dict[str, list[Callable]] = {name: [fn] for name, fn in (initial or {}).items()}
        self.rest: list[Callable] = []

    def on(self, name: str, fn: Callable) -> Callable[[], None]:
        """Listen; the function returned stops it."""
        self.listeners.setdefault(name, []).append(fn)
        return lambda: self.off(name, fn)

    def off(self, name: str, fn: Callable) -> None:
        if fn in self.listeners.get(name, []):
            self.listeners[name].remove(fn)

    def unhandled(self, fn: Callable) -> Callable[[], None]:
        """Listen to all names that never had a listener, as fn(name, ...); the function returned stops it."""
        self.rest.append(fn)
        return lambda: self.unhandled_off(fn)

    def unhandled_off(self, fn: Callable) -> None:
        if fn in self.rest:
            self.rest.remove(fn)

    def emit(self, name: str, *args: Any) -> list:
        """What the listeners return."""
        own = self.listeners.get(name)
        return [fn(*args) for fn in list(own)] if own is not None else [fn(name, *args) for fn in list(self.rest)]

    def child(self, initial: dict[str, Callable] | None = None) -> Hub:
        """A hub of its own that hands names it does not handle to this one."""
        out = Hub(initial)
        out.unhandled(self.emit)
        return out

    def effect(self, fn: Callable[[Hub], Callable[[], object] | None]) -> Callable[[], Callable[[], None]]:
        """Listeners to be set together: each call of what is returned runs ``fn`` with a hub to listen on and gives a function that stops them all and then calls what ``fn`` returned."""

        def start() -> Callable[[], None]:
            stops: list[Callable[[], None]] = []
            seen = _Recording(self, stops)
            last = fn(seen)

            def stop() -> None:
                for s in stops:
                    s()
                if last:
                    last()

            return stop

        return start


class _Recording(Hub):
    """A view of a hub that remembers how to stop what listens through it."""

    def __init__(self, hub: Hub, stops: list) -> None:
        self.listeners, self.rest, self.stops = hub.listeners, hub.rest, stops

    def on(self, name: str, fn: Callable) -> Callable[[], None]:
        stop = super().on(name, fn)
        self.stops.append(stop)
        return stop
