"""A registry of named implementations by group, observers of events, and executors run per job."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions import geometry, shoebox

_GROUPS: dict[str, dict[str, Callable]] = defaultdict(dict)
_DEFAULTS: dict[str, str] = {}


def register(group: str, name: str, default: bool = False):
    """Adds what it decorates under a name."""
    def add(f):
        _GROUPS[group][name] = f
        if default or group not in _DEFAULTS:
            _DEFAULTS[group] = name
        return f

    return add


def groups() -> list[str]:
    return sorted(_GROUPS)


def extensions(group: str) -> list[str]:
    """Names of a group, the default first."""
    return sorted(_GROUPS[group], key=lambda n: (n != _DEFAULTS.get(group), n))


def load(group: str, name: str | None = None) -> Callable:
    """An implementation by name, or the default; KeyError for an unknown one."""
    if group not in _GROUPS:
        raise KeyError(f"no group {group}")
    name = name or _DEFAULTS[group]
    if name not in _GROUPS[group]:
        raise KeyError(f"no {name} in {group}; known: {', '.join(extensions(group))}")
    return _GROUPS[group][name]


register("centroid", "simple", default=True)(shoebox.centroid_of)
register("background", "simple", default=True)(shoebox.mean_background)
register("background", "glm")(shoebox.robust_poisson_mean)
register("background", "null")(lambda data, mask: data[0] * 0)
register("outliers", "nsigma", default=True)(shoebox.within_deviations)
register("outliers", "truncated")(shoebox.within_quantiles)
register("outliers", "tukey")(shoebox.within_quartiles)
register("intensity", "sum", default=True)(shoebox.summed_intensity)
register("intensity", "bayesian")(shoebox.bayesian_intensity)
register("scaling", "kb", default=True)(lambda scale, b, d: scale * geometry.debye_waller(b, d))


class Subject:
    """Calls observers of an event, in the order in which they came."""

    def __init__(self, events: list[str]):
        self._observers: dict[str, dict[str, Callable]] = {e: {} for e in events}

    def attach(self, event: str, name: str, callback: Callable) -> None:
        self._observers[event][name] = callback

    def detach(self, event: str, name: str) -> None:
        del self._observers[event][name]

    def notify(self, event: str) -> None:
        for callback in list(self._observers[event].values()):
            callback(self)


class Executor:
    """What runs over the rows of each job: ``begin`` before the first, ``process`` for each part, ``end`` after the last."""

    def begin(self, job: int) -> None:
        pass

    def process(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows

    def end(self) -> None:
        pass


def run_jobs(table: DataFrame, job: str, executor: Callable[[], Executor], schema) -> DataFrame:
    """The parts that an executor makes of each job's rows; a job streams through one task in Arrow batches."""
    def run(frames) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for f in frames:
            for j, part in f.groupby(job, sort=False):
                if now is None or j != last:
                    if now is not None:
                        now.end()
                    now, last = executor(), j
                    now.begin(j)
                yield now.process(part)
        if now is not None:
            now.end()

    return table.repartition(job).sortWithinPartitions(job).mapInPandas(run, schema)
