"""Bronze, silver and gold tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.writers import write_path

Bronze = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Layers:
    """Where each layer was written: alias or output name -> path."""

    bronze: dict[str, str]
    silver: str
    gold: dict[str, str] = field(default_factory=dict)


def layer_name(name: str) -> str:
    """Letters, digits and underscores only."""
    return re.sub(r"\W+", "_", name).strip("_").lower() or "table"


def medallion(
    spark: SparkSession,
    name: str,
    sources: Mapping[str, str | DataFrame],
    silver: Callable[[Bronze], DataFrame],
    gold: Mapping[str, Callable[[DataFrame, Bronze], DataFrame]],
    base_path: str,
    read: Callable[[str], DataFrame] | None = None,
) -> Layers:
    """Land each distinct source as bronze, derive silver from bronze, gold from silver.

    ``sources`` maps an alias to a table name (read with ``read``, by default from
    the catalog) or a DataFrame; aliases of the same source share one bronze table.
    Each layer is written and read back, so the next starts from stored columns and
    each gold output computes only what it uses.
    """
    read = read or spark.table
    bronze_paths: dict[str, str] = {}
    landed: list[tuple[str | DataFrame, str]] = []
    taken: set[str] = set()
    for alias, source in sources.items():
        path = next((p for s, p in landed if s is source or (isinstance(s, str) and s == source)), None)
        if path is None:
            path = f"{base_path}/{_free(f'bronze_{layer_name(alias)}', taken)}"
            write_path(read(source) if isinstance(source, str) else source, path)
            landed.append((source, path))
        bronze_paths[alias] = path
    bronze = {alias: spark.read.parquet(path) for alias, path in bronze_paths.items()}

    silver_path = f"{base_path}/{_free(f'silver_{layer_name(name)}', taken)}"
    write_path(silver(bronze), silver_path)
    clean = spark.read.parquet(silver_path)

    gold_paths = {}
    for output, build in gold.items():
        gold_paths[output] = f"{base_path}/{_free(f'gold_{layer_name(output)}', taken)}"
        write_path(build(clean, bronze), gold_paths[output])
    return Layers(bronze_paths, silver_path, gold_paths)


def _free(name: str, taken: set[str]) -> str:
    """The name, numbered when two outputs would share it."""
    free, n = name, 2
    while free in taken:
        free, n = f"{name}_{n}", n + 1
    taken.add(free)
    return free
