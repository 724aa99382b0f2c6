"""An in-process event bus: spans around queries, writes and graph iterations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

Handler = Callable[[tuple[str, ...], dict, dict], None]
_handlers: dict[str, tuple[tuple[str, ...], Handler]] = {}


def attach(handler_id: str, event: tuple[str, ...], handler: Handler) -> None:
    """Call ``handler(event, measurements, metadata)`` for events that start with ``event``."""
    if handler_id in _handlers:
        raise ValueError(f"handler {handler_id!r} is attached already")
    _handlers[handler_id] = (tuple(event), handler)


def detach(handler_id: str) -> None:
    _handlers.pop(handler_id, None)


def emit(event: tuple[str, ...], measurements: dict, metadata: dict) -> None:
    for prefix, handler in list(_handlers.values()):
        if event[: len(prefix)] == prefix:
            handler(event, measurements, metadata)


@contextmanager
def span(event: tuple[str, ...], **metadata: object) -> Iterator[dict]:
    """start, then stop with the duration, or exception; the block may add to the metadata."""
    began, info = time.perf_counter(), dict(metadata)
    emit((*event, "start"), {"system_time": time.time()}, info)
    try:
        yield info
    except Exception as e:
        emit((*event, "exception"), {"duration": time.perf_counter() - began}, info | {"reason": e})
        raise
    emit((*event, "stop"), {"duration": time.perf_counter() - began}, info)
