"""Declared experiments as rows: what is to be evaluated, with which settings, and what of it is still to do."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import run_and_checkpoint

OWN = {"name", "path", "kinds"}


def experiments(spark: SparkSession, declared: Iterable[Mapping], defaults: Mapping, known: Iterable[str]) -> DataFrame:
    """(name, path, run, checkpoint, kind, settings): a row for each kind of each experiment, in which the experiment's own
    settings come before the defaults.

    An experiment gives its name, path and kinds, and any setting that has a default. Kinds that aren't ``known``, settings
    without a default, missing keys and repeated names are errors, before anything runs. The list is written by hand.
    """
    rows, names, known = [], set(), set(known)
    for e in declared:
        if lacking := OWN - set(e):
            raise ValueError(f"an experiment lacks {sorted(lacking)}")
        if e["name"] in names:
            raise ValueError(f"two experiments are named {e['name']}")
        if strange := (set(e) - OWN - set(defaults)) | (set(e["kinds"]) - known):
            raise ValueError(f"{e['name']}: unknown {sorted(strange)}")
        names.add(e["name"])
        settings = json.dumps({k: e.get(k, v) for k, v in defaults.items()}, ensure_ascii=False, sort_keys=True)
        rows += [(e["name"], e["path"], kind, settings) for kind in dict.fromkeys(e["kinds"])]
    run, checkpoint = run_and_checkpoint(F.col("path"))
    found = spark.createDataFrame(rows, "name string, path string, kind string, settings string")
    return found.select("name", "path", run.alias("run"), checkpoint.alias("checkpoint"), "kind", "settings")


def pending(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Planned rows that ``results`` (name, kind) doesn't hold yet."""
    return planned.join(results.select("name", "kind").distinct(), ["name", "kind"], "left_anti")
