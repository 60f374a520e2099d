"""Lineage events and row counts captured while a job runs, and hooks around it."""

from __future__ import annotations

import contextlib
import json
import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
EVENT = "run_id string, job string, state string, inputs array<string>, outputs array<string>, at double, detail string"


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row count that comes with whichever action runs it: no job of its own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def schema_facet(df: DataFrame) -> str:
    return json.dumps([{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields])


class Lineage:
    """START, then COMPLETE or FAIL for each job; an emitter that fails never breaks the job."""

    def __init__(self, emit: Callable[[dict], None] | None = None):
        self.events: list[dict] = []
        self._emit = emit

    def _send(self, **event) -> None:
        event = event | {"at": time.time()}
        self.events.append(event)
        if self._emit:
            try:
                self._emit(event)
            except Exception:
                log.warning("lineage event was not delivered", exc_info=True)

    @contextlib.contextmanager
    def job(self, name: str, inputs: list[str], outputs: list[str]):
        about = {"run_id": uuid.uuid4().hex, "job": name, "inputs": inputs, "outputs": outputs}
        self._send(**about, state="START", detail=None)
        try:
            yield about
        except Exception as e:
            self._send(**about, state="FAIL", detail=str(e)[:500])
            raise
        self._send(**about, state="COMPLETE", detail=about.pop("detail", None))

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [x.split()[0] for x in EVENT.split(", ")]
        return spark.createDataFrame([tuple(e.get(n) for n in names) for e in self.events], EVENT)


class Hooks:
    """Named callables around an inference; one that fails is logged and passed over, and none replaces the data."""

    PHASES = ("pre", "post", "explain")

    def __init__(self):
        self._by = {p: {} for p in self.PHASES}

    def register(self, phase: str, name: str, call: Callable[[DataFrame], object]) -> None:
        self._by[phase][name] = call

    def run(self, phase: str, df: DataFrame) -> dict[str, object]:
        out = {}
        for name, call in self._by[phase].items():
            try:
                out[name] = call(df)
            except Exception:
                log.warning("hook %s failed", name, exc_info=True)
        return out
