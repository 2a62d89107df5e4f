"""Review decisions as an append-only log.

A decision is one appended row, so writers never read before they write.  The
state of a theme is its latest event; a delete is an event as well.

Many small files are slow to read.  A compaction writes all events into a folder of the next generation, with a manifest that names the event
files it covers.  Readers take the newest generation with a whole manifest and all event files it does not cover, so what is saved
during a compaction, by whomever, is never lost, and every holder of the log sees the same.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtally import fixed
from voxtally.functions.skew import lookup_join

#: Folder of the compacted generations inside that of the log; hidden from a plain read of it.
GENERATIONS = "_generations"
LOG_SCHEMA = "theme_name string, action string, status string, reviewer_note string, event_time timestamp, event_id string"


class DecisionStore:
    """Log of decisions in a folder every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        """All events: the newest generation and the event files after it."""
        number, folder, covered = self._generation()
        return self._events(folder, self._files(covered))

    def _events(self, folder: str | None, files: list[str]) -> DataFrame:
        read = self.spark.read.schema(LOG_SCHEMA).parquet
        frames = ([read(folder)] if folder else []) + ([read(*files)] if files else [])
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], LOG_SCHEMA)

    def _place(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, path: str) -> list[str]:
        place = self._place(path)
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []

    def _files(self, covered: set[str]) -> list[str]:
        names = [n for n in self._listed(self.path) if n.endswith(".parquet") and n[0] not in "_." and n not in covered]
        return [f"{self.path.rstrip('/')}/{n}" for n in names]

    def _generation(self) -> tuple[int, str | None, set[str]]:
        """(number, folder, covered event files) of the newest generation; one whose manifest is not whole yet does not count."""
        home = f"{self.path.rstrip('/')}/{GENERATIONS}"
        for name in sorted((n for n in self._listed(home) if re.fullmatch(r"\d{8}\.json", n)), reverse=True):
            row = self.spark.read.text(f"{home}/{name}", wholetext=True).first()
            try:
                told = json.loads(row["value"]) if row else None
            except ValueError:
                told = None
            if told:
                return int(name[:8]), f"{home}/{told['folder']}", set(told["covered"])
        return 0, None, set()

    def state(self) -> DataFrame:
        return decision_state(self.log())

    def save_decision(self, theme_name: str, status: str = "pending", reviewer_note: str | None = "") -> dict:
        """Append a decision and return the theme's state."""
        theme = _theme(theme_name)
        if status not in fixed.REVIEW_STATUSES:
            raise ValueError(f"'{status}' is none of {fixed.REVIEW_STATUSES}.")
        self._append([(theme, "save", status, str(reviewer_note) if reviewer_note is not None else "")])
        return self.get_decision(theme)

    def get_decision(self, theme_name: str) -> dict | None:
        row = decision_state(self.log().where(F.col("theme_name") == _theme(theme_name))).first()
        return row.asDict() if row else None

    def all_decisions(self) -> DataFrame:
        return self.state()

    def delete_decision(self, theme_name: str) -> bool:
        """Remove one decision; false when there was none."""
        existed = self.get_decision(theme_name) is not None
        if existed:
            self._append([(_theme(theme_name), "delete", None, None)])
        return existed

    def clear_decisions(self) -> int:
        """Remove all decisions and return how many there were.  The tombstones are written by Spark."""
        current = self.state().select("theme_name")
        count = current.count()
        if count:
            self._write(
                current.select("theme_name", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("status"),
                               F.lit(None).cast("string").alias("reviewer_note"), F.lit(_now()).alias("event_time"),
                               F.expr("uuid()").alias("event_id"))
            )
        return count

    def compact(self) -> int:
        """Write all events into a folder of the next generation, sorted by theme, and return the number of events.

        Of two compactions at a time the one that creates the manifest first counts; the other's folder goes. Nothing else is removed: event files and
        older generations stay for whoever reads them just now, until ``vacuum``.
        """
        number, folder, covered = self._generation()
        files = self._files(covered)
        events = self._events(folder, files)
        home, name = f"{self.path.rstrip('/')}/{GENERATIONS}", f"{number + 1:08d}-{uuid.uuid4().hex}"
        events.repartitionByRange("theme_name", "event_time").write.parquet(f"{home}/{name}")
        place = self._place(f"{home}/{number + 1:08d}.json")
        system = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = system.create(place, False)
        except Py4JJavaError as problem:
            if "FileAlreadyExists" not in problem.java_exception.toString() and "already exists" not in problem.java_exception.toString():
                raise
            system.delete(self._place(f"{home}/{name}"), True)
        else:
            still_there = covered & set(self._listed(self.path))
            told = {"folder": name, "covered": sorted(still_there | {f.rsplit("/", 1)[1] for f in files})}
            out.write(bytearray(json.dumps(told).encode()))
            out.close()
        return self.log().count()

    def vacuum(self) -> int:
        """Remove the event files that the newest generation covers and older generations, and return how many files went.

        To be called when no reader can still be at work that began before that generation.
        """
        number, folder, covered = self._generation()
        root = self.path.rstrip("/")
        gone = [f"{root}/{n}" for n in self._listed(root) if n in covered]
        keep = {f"{number:08d}.json", (folder or "").rsplit("/", 1)[-1]}
        older = [n for n in self._listed(f"{root}/{GENERATIONS}") if n not in keep and re.match(r"\d{8}", n) and int(n[:8]) <= number]
        gone += [f"{root}/{GENERATIONS}/{n}" for n in older]
        for path in gone:
            place = self._place(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return len(gone)

    def _append(self, events: list[tuple]) -> None:
        rows = [(*e, _now(), uuid.uuid4().hex) for e in events]
        self._write(self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1))

    def _write(self, events: DataFrame) -> None:
        events.write.mode("append").parquet(self.path)


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _theme(theme_name: str) -> str:
    if not isinstance(theme_name, str) or not theme_name.strip():
        raise ValueError("A decision needs the name of a theme.")
    return theme_name.strip()


def decision_state(log: DataFrame) -> DataFrame:
    """Latest decision per theme.  ``created_at`` is the first save after the last delete.

    Two aggregates with map-side partials; a theme decided a million times is
    still reduced before the shuffle.
    """
    deletes = log.where("action = 'delete'").groupBy("theme_name").agg(
        F.max(F.struct("event_time", "event_id")).alias("_gone")
    )
    saves = log.where("action = 'save'").join(deletes, "theme_name", "left")
    alive = saves.where(F.col("_gone").isNull() | (F.struct("event_time", "event_id") > F.col("_gone")))
    last = F.max_by(F.struct("status", "reviewer_note"), F.struct("event_time", "event_id"))
    return alive.groupBy("theme_name").agg(
        last.alias("d"), F.min("event_time").alias("created_at"), F.max("event_time").alias("updated_at")
    ).select("theme_name", "d.status", "d.reviewer_note", "created_at", "updated_at")


def apply_decisions(df: DataFrame, decisions: DataFrame | None, theme: str = "theme_name") -> DataFrame:
    """Adds ``review_status`` and ``reviewer_note`` by theme, with ``pending`` and "" as defaults.

    For records (``theme`` names their theme column) a few themes usually hold most
    rows.  Decisions are one row per theme, so Spark broadcasts them after it has seen
    their size; beyond that a theme's records are split by adaptive execution.
    """
    default = F.col("human_review_status") if "human_review_status" in df.columns else F.lit("pending")
    if decisions is None:
        return df.withColumns({"review_status": default, "reviewer_note": F.lit("")})
    own = decisions.select(F.col("theme_name").alias(theme), F.col("status").alias("_status"), F.col("reviewer_note").alias("_note"))
    joined = lookup_join(df, own, theme)
    return joined.withColumns(
        {"review_status": F.coalesce("_status", default), "reviewer_note": F.coalesce("_note", F.lit(""))}
    ).drop("_status", "_note")
