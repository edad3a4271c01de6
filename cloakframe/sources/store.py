"""A versioned store of keyed rows: parts of Parquet, and a log of manifests that name the live ones.

A commit writes its part first and then a manifest under the next number, by a rename that fails where the
number is taken: readers see all of a commit or nothing, and of two writers one tries again. A manifest
holds the whole state, so reading takes one listing of the log and one small file, whatever the history:

* ``parts``: folder, ``seq`` (the order of saving), level, and the run and generation it came from;
* ``done``: for each run the ranges of generations that are in the store, so a retried batch is known;
* ``dropped``: parts that a later manifest no longer names, deleted two foldings later.

Parts are folded by level: as many parts of a level as ``FAN`` become one of the next, so a row is rewritten
once per level and a store of any age has a few parts per level. Manifests older than ``KEPT`` are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 16
KEPT = 20
_LOG = "_log"


def _with(ranges: list[list[int]], n: int) -> list[list[int]]:
    """Sorted ranges, ends included, with one more number."""
    out: list[list[int]] = []
    for low, high in sorted([*ranges, [n, n]]):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


@dataclass(frozen=True)
class Store:
    """``schema`` is that of the rows; ``fold`` makes one row per key of rows that also have ``seq``."""

    spark: SparkSession
    path: str
    schema: str
    fold: Callable[[DataFrame], DataFrame]

    # -- the log ---------------------------------------------------------------------------------

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *names)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        files, log = self._files(), self._path(_LOG)
        if not files.exists(log):
            return []
        names = [s.getPath().getName() for s in files.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def state(self) -> dict:
        """The newest manifest; that of an empty store where nobody has written yet."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "parts": [], "done": {}, "dropped": []}
        stream = self._files().open(self._path(_LOG, f"{versions[-1]:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> bool:
        """Put the state under the next number. False where another writer has taken it."""
        jvm, files = self.spark._jvm, self._files()
        number = state["version"] + 1
        draft, place = self._path(_LOG, f".{uuid.uuid4().hex}.json"), self._path(_LOG, f"{number:020d}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps({**state, "version": number}).encode()))
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(place), never)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        if number % KEPT == 0:
            for old in self._versions()[:-KEPT]:
                files.delete(self._path(_LOG, f"{old:020d}.json"), False)
        return True

    # -- reading ---------------------------------------------------------------------------------

    def rows(self, parts: list[dict] | None = None) -> DataFrame:
        """The rows of a snapshot with ``seq``; later commits do not change what this reads."""
        parts = self.state()["parts"] if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, seq long")
        read = self.spark.read.schema(f"{self.schema}, part string").option("basePath", self.path)
        rows = read.parquet(*[f"{self.path.rstrip('/')}/part={p['part']}" for p in parts])
        seq = F.create_map(*[F.lit(x) for p in parts for x in (p["part"], p["seq"])])
        return rows.withColumn("seq", F.try_element_at(seq, F.col("part")).cast("long")).drop("part")

    def current(self) -> DataFrame:
        return self.fold(self.rows())

    # -- writing ---------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path.rstrip('/')}/part={part}")
        return part

    def holds(self, run: str, generation: int) -> bool:
        return any(low <= generation <= high for low, high in self.state()["done"].get(run, []))

    def commit(self, rows: DataFrame, run: str, generation: int, replace: bool = True) -> bool:
        """Add a generation of a run; False where it was there and has been left as it is.

        A generation that is still a part of its own is replaced, unless ``replace`` is off; one that has been
        folded stays.
        """
        if not replace and self.holds(run, generation):
            return False
        part = self._write(rows)
        while True:
            state = self.state()
            mine = [p for p in state["parts"] if (p["run"], p["generation"]) == (run, generation)]
            known = any(low <= generation <= high for low, high in state["done"].get(run, []))
            if known and (not mine or not replace):
                self._files().delete(self._path(f"part={part}"), True)
                return False
            number = state["version"] + 1
            entry = {"part": part, "seq": mine[0]["seq"] if mine else number, "level": 0, "run": run, "generation": generation}
            new = {
                **state,
                "parts": [p for p in state["parts"] if p not in mine] + [entry],
                "done": {**state["done"], run: _with(state["done"].get(run, []), generation)},
                "dropped": state["dropped"] + [{"part": p["part"], "age": 0} for p in mine],
            }
            if self._publish(new):
                break
        level = 0
        while len([p for p in new["parts"] if p["level"] == level]) >= FAN:
            if not self.compact(level):
                break
            new, level = self.state(), level + 1
        return True

    def compact(self, level: int | None = None) -> bool:
        """Fold the parts of a level, or all parts, into one, in place; False where another writer was quicker.

        Readers of earlier snapshots keep their parts until two foldings later.
        """
        state = self.state()
        old = [p for p in state["parts"] if level is None or p["level"] == level]
        if len(old) < 2:
            return True
        entry = {
            "part": self._write(self.fold(self.rows(old))),
            "seq": max(p["seq"] for p in old),
            "level": 1 + max(p["level"] for p in old),
            "run": None,
            "generation": None,
        }
        while True:
            state = self.state()
            if not all(p in state["parts"] for p in old):
                self._files().delete(self._path(f"part={entry['part']}"), True)
                return False
            gone = [d for d in state["dropped"] if d["age"] >= 1]
            kept = [{**d, "age": d["age"] + 1} for d in state["dropped"] if d["age"] < 1]
            new = {
                **state,
                "parts": [p for p in state["parts"] if p not in old] + [entry],
                "dropped": kept + [{"part": p["part"], "age": 0} for p in old],
            }
            if self._publish(new):
                for d in gone:
                    self._files().delete(self._path(f"part={d['part']}"), True)
                return True
