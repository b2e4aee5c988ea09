"""Tools that a caller may run: a registry with an allow-list, a time limit, retries and a bounded cache of results."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from granary.operators import guard


class ToolError(RuntimeError):
    """A tool that is unknown, not allowed, or failed after its last attempt."""


def idempotency_key(tool: str, args: dict) -> str:
    """The same for equal calls: a digest of the tool and its arguments in canonical form."""
    import hashlib

    return hashlib.sha256(f"{tool}\0{json.dumps(args, sort_keys=True, separators=(',', ':'))}".encode()).hexdigest()[:32]


def collect_within(frame: DataFrame, seconds: float) -> list:
    """The rows of a frame; its jobs are cancelled, and TimeoutError raised, if they take longer."""
    spark = frame.sparkSession
    tag, found = f"granary-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.addTag(tag)
        try:
            found["rows"] = frame.collect()
        except Exception as e:  # noqa: BLE001  handed to the caller
            found["error"] = e
        finally:
            spark.removeTag(tag)

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        spark.interruptTag(tag)
        raise TimeoutError(f"no result within {seconds} s")
    if "error" in found:
        raise found["error"]
    return found["rows"]


@dataclass
class Toolbox:
    """Tools by name. Results live ``ttl`` seconds in a cache of at most ``most`` entries, the oldest going first."""

    ttl: float = 300.0
    most: int = 256
    attempts: int = 3
    wait: float = 0.05
    clock: Callable[[], float] = time.monotonic
    tools: dict[str, Callable[[dict], object]] = field(default_factory=dict)
    _held: OrderedDict = field(default_factory=OrderedDict)

    def register(self, name: str, run: Callable[[dict], object]) -> None:
        self.tools[name] = run

    def call(self, name: str, args: dict | None = None, allowed: Collection[str] | None = None) -> object:
        """A tool's result: from the cache, else of the first attempt that doesn't fail."""
        args = args or {}
        if name not in self.tools:
            raise ToolError(f"unknown tool {name!r}")
        if allowed is not None and name not in allowed:
            raise ToolError(f"tool {name!r} is not allowed here")
        key, now = idempotency_key(name, args), self.clock()
        if key in self._held and now < self._held[key][0] + self.ttl:
            return self._held[key][1]
        for attempt in range(1, self.attempts + 1):
            try:
                found = self.tools[name](args)
                break
            except (ValueError, TypeError) as e:  # arguments that won't get better
                raise ToolError(str(e)) from e
            except Exception as e:  # noqa: BLE001
                if attempt == self.attempts:
                    raise ToolError(str(e)) from e
                time.sleep(self.wait * 2 ** (attempt - 1))
        self._held.pop(key, None)
        self._held[key] = (now, found)
        while len(self._held) > self.most:
            self._held.popitem(last=False)
        return found


def standard(spark: SparkSession, seconds: float = 30.0, **more: Callable[[dict], object]) -> Toolbox:
    """A toolbox with the calculator and the guarded SQL surface, and what else is handed over."""
    box = Toolbox()
    box.register("calculate", lambda a: guard.safe_eval(a["expression"]))
    box.register("query_database", lambda a: [r.asDict() for r in collect_within(guard.run_sql(spark, a["sql"], a.get("params"), a.get("max_rows", 100)), seconds)])
    for name, run in more.items():
        box.register(name, run)
    return box
