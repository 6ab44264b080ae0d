"""Changes of several stores that are made together: recorded, then committed or cancelled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from deltaloom.hub import Hub
from deltaloom.sources.store import Store


@dataclass
class Operation:
    """What to put into (``key``, ``value``) and delete from (``key``) a store, by its name, and what to call once that is settled."""

    store: str
    put: DataFrame | None = None
    delete: DataFrame | None = None
    on_commit: Callable[[], object] | None = None
    on_cancel: Callable[[], object] | None = None


@dataclass
class Operations:
    """Pending operations of some stores.

    Nothing is changed before :meth:`commit`, which applies what was recorded
    in its order, tells each operation, and then the hub, under "operations
    committed"; :meth:`cancel` drops it all and says "operations cancelled".
    Stores are immutable: after a commit ``stores`` holds the new ones.
    """

    stores: dict[str, Store]
    hub: Hub = field(default_factory=Hub)
    pending: list[Operation] = field(default_factory=list)

    def record(self, operation: Operation) -> None:
        if operation.store not in self.stores:
            raise KeyError(operation.store)
        self.pending.append(operation)

    def commit(self) -> dict[str, Store]:
        done, self.pending = self.pending, []
        stores = dict(self.stores)
        for o in done:
            stores[o.store] = stores[o.store].batch(put=o.put, del_=o.delete)
        self.stores = stores
        for o in done:
            if o.on_commit:
                o.on_commit()
        self.hub.emit("operations committed")
        return stores

    def cancel(self) -> None:
        done, self.pending = self.pending, []
        for o in done:
            if o.on_cancel:
                o.on_cancel()
        self.hub.emit("operations cancelled")

    def after_commit(self, fn: Callable[[], object]) -> None:
        """Call a function once if what is pending is committed, never if it is cancelled."""

        def committed() -> None:
            stop()
            fn()

        def stop() -> None:
            for s in stops:
                s()

        stops = [self.hub.on("operations committed", committed), self.hub.on("operations cancelled", stop)]
