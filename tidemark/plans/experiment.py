"""Experiments: times of graphs over a grid of settings, as a table of tab-separated lines."""

from __future__ import annotations

import itertools
import statistics
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.frame import Frame
from tidemark.plans.session import Session

PHASES = ("naive", "initial", "update")


def _timed(f: Callable[[], object]) -> float:
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def _once(spark: SparkSession, rows: DataFrame, key: str, changed: Callable[[int], DataFrame], build: Callable[..., Frame], setting: dict) -> dict[str, float]:
    options = {k: v for k, v in setting.items() if k not in ("partitions", "update")}
    session = Session(spark)
    table = session.create_table("t", key, rows.repartition(setting["partitions"]) if "partitions" in setting else rows)
    frame = build(session.frame(table), **options)
    out = {
        "naive": _timed(lambda: frame.full().write.format("noop").mode("overwrite").save()),
        "initial": _timed(lambda: session.run(frame)),
    }
    table.put_all(changed(setting.get("update", 1)))
    out["update"] = _timed(session.propagate)
    session.close()
    return out


def sweep(spark: SparkSession, rows: DataFrame, key: str, changed: Callable[[int], DataFrame], build: Callable[..., Frame], grid: dict[str, list], repeats: int = 3) -> Iterator[dict]:
    """One row for each combination of the grid: its settings, mean and deviation of each phase over ``repeats`` runs.

    ``partitions`` and ``update`` (changed rows of a batch) are settings of the run; any other goes to ``build``. One
    run before the first isn't counted.
    """
    names = list(grid)
    for i, values in enumerate(itertools.product(*grid.values())):
        setting = dict(zip(names, values))
        if not i:
            _once(spark, rows, key, changed, build, setting)
        runs = [_once(spark, rows, key, changed, build, setting) for _ in range(repeats)]
        yield setting | {f"{p}_{m}": round(f([r[p] for r in runs]), 4) for p in PHASES for m, f in (("mean", statistics.mean), ("std", statistics.pstdev))}


def as_table(results: list[dict]) -> str:
    """Tab-separated lines, a line of names first."""
    names = list(results[0]) if results else []
    return "".join("\t".join(map(str, line)) + "\n" for line in [names, *([r[n] for n in names] for r in results)])
