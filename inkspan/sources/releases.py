"""Outputs that are published together: a version is written aside, and one rename makes it the current one.

Under a directory, ``versions/<id>`` holds what a run has written and ``CURRENT`` the id of the version that readers
get. A run that ends half-way leaves its version unnamed and the former one whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession

_NAME = "CURRENT"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict | None:
    place, fs = _place(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, value: dict) -> None:
    place, fs = _place(spark, path)
    stream = fs.create(place, True)
    stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    stream.close()


def publish(spark: SparkSession, directory: str, outputs: dict[str, Callable[[str], object]]) -> str:
    """Writes every output, a function of its path, into a new version and makes it current; returns its path.

    The manifest names the outputs and is the last file of the version. ``CURRENT`` is replaced by renaming a whole
    file over it, which file systems do at once. If an output fails, nothing is renamed and the error is raised.
    """
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    at = f"{directory}/versions/{version}"
    for name, write in outputs.items():
        write(f"{at}/{name}")
    _write(spark, f"{at}/MANIFEST", {"version": version, "outputs": sorted(outputs)})
    _write(spark, f"{directory}/.{version}", {"version": version})
    jvm = spark.sparkContext._jvm
    new, old = (fs.makeQualified(place) for place, fs in (_place(spark, f"{directory}/{x}") for x in (f".{version}", _NAME)))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, old, options)
    return at


def current(spark: SparkSession, directory: str) -> str | None:
    """The path of the current version, or None before the first; one that is read stays whole while another comes."""
    found = _read(spark, f"{directory}/{_NAME}")
    return found and f"{directory}/versions/{found['version']}"


def outputs(spark: SparkSession, directory: str) -> list[str]:
    """Names of the current version's outputs."""
    at = current(spark, directory)
    return _read(spark, f"{at}/MANIFEST")["outputs"] if at else []


def prune(spark: SparkSession, directory: str, keep: int = 2) -> list[str]:
    """Removes versions but for the current one and the ``keep`` latest, unfinished ones among the rest; returns the
    removed ids. Not to be run while another run writes."""
    place, fs = _place(spark, f"{directory}/versions")
    names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
    whole = [n for n in names if fs.exists(_place(spark, f"{directory}/versions/{n}/MANIFEST")[0])]
    now = current(spark, directory)
    gone = [n for n in names if n not in whole[len(whole) - keep :] and not (now and now.endswith(f"/{n}"))]
    for n in gone:
        fs.delete(_place(spark, f"{directory}/versions/{n}")[0], True)
    return gone
