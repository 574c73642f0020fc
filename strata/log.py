"""Logging: lines of time, level, place and message, written by a thread of their own."""

from __future__ import annotations

import logging
import logging.handlers
import queue
from pathlib import Path

FORMAT = "%(asctime)s [%(levelname)s] %(filename)s:%(lineno)d: %(message)s"
_listener: logging.handlers.QueueListener | None = None


def get() -> logging.Logger:
    return logging.getLogger("strata")


def start(*sinks: logging.Handler, level: int = logging.INFO) -> None:
    """Sends records to the sinks; earlier ones are removed."""
    global _listener
    stop()
    held: queue.SimpleQueue = queue.SimpleQueue()
    for sink in sinks:
        sink.setFormatter(logging.Formatter(FORMAT))
    get().addHandler(logging.handlers.QueueHandler(held))
    get().setLevel(level)
    _listener = logging.handlers.QueueListener(held, *sinks)
    _listener.start()


def stop() -> None:
    """Writes what is waiting, and removes the sinks."""
    global _listener
    if _listener:
        _listener.stop()
        for sink in _listener.handlers:
            sink.close()
        _listener = None
    for handler in get().handlers[:]:
        get().removeHandler(handler)


def console() -> logging.Handler:
    return logging.StreamHandler()


def file(folder: str) -> logging.Handler:
    """Appends to strata.log in the folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    return logging.FileHandler(Path(folder) / "strata.log")
