"""An append-only table of committed batches, for writers that know nothing of each other.

An append writes its rows to a folder of its own and then commits: it creates the batch's entry in the log, which names that
folder. Only one attempt can create the entry, so a batch that is tried again (by its id) counts once, a writer that dies before
the commit leaves nothing that is read, and writers side by side never wait for each other. Readers take the folders that
entries name.

A snapshot moves what was appended since the last one into history (partitioned by date) and merges it into the table of latest
rows; it is one conditional create as well. Readers take the newest snapshot and the batches it doesn't cover, so the
latest rows cost no pass over history. The driver reads the names of the batches since the snapshot and no row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.sources.files import Files, name_of

DATE = "date_updated"


class BatchLog:
    """One table below ``root``. ``newest`` takes a frame to the latest row of each key."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, newest: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.schema, self.newest, self.files = spark, root.rstrip("/"), schema, newest, Files(spark)

    def append(self, frame: DataFrame, batch: str | None = None) -> str:
        """Add the rows of ``frame`` (columns by name, missing ones null) as one batch; one that is committed already stays as it is."""
        batch = batch or uuid.uuid4().hex
        entry = f"{self.root}/log/{batch}"
        if not self.files.exists(entry):
            have = {c.lower(): c for c in frame.columns}
            columns = [(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
            place = f"data/{batch}.{uuid.uuid4().hex[:12]}"
            frame.select(*columns).write.parquet(f"{self.root}/{place}")
            self.files.create_new(entry, place)
        return batch

    def _snapshot(self) -> dict:
        found = self.files.files(f"{self.root}/snapshots") if self.files.exists(f"{self.root}/snapshots") else []
        if not found:
            return {"number": 0, "history": [], "latest": None, "covers": []}
        return json.loads(self.files.read_text(found[-1]))

    def _batches(self, snapshot: dict) -> dict[str, str]:
        """Batches that the snapshot doesn't cover, with their folders."""
        if not self.files.exists(f"{self.root}/log"):
            return {}
        covered = set(snapshot["covers"])
        entries = {name_of(f): f for f in self.files.files(f"{self.root}/log") if not name_of(f).startswith(".")}
        return {name: self.files.read_text(f) for name, f in entries.items() if name not in covered}

    def _load(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema)
        if "=" in places[0]:  # folders of snapshots, partitioned by date
            reader = reader.option("basePath", f"{self.root}/{places[0].split('/')[0]}")
        return reader.parquet(*[f"{self.root}/{p}" for p in places]).select(*self.schema.names)

    def read(self) -> DataFrame:
        """Every row that is committed now."""
        snapshot = self._snapshot()
        return self._load(snapshot["history"]).unionByName(self._load(list(self._batches(snapshot).values())))

    def latest(self, since: object | None = None) -> DataFrame:
        """The latest row of each key; with ``since`` only those of that date or later, and only such partitions of the snapshot are read."""
        snapshot = self._snapshot()
        known = self._load([snapshot["latest"]] if snapshot["latest"] else [])
        if since is not None:
            # An earlier row of the snapshot is either replaced by a batch or too old; neither needs it.
            known = known.where(F.col(DATE) >= F.lit(since))
        found = self.newest(known.unionByName(self._load(list(self._batches(snapshot).values()))))
        return found if since is None else found.where(F.col(DATE) >= F.lit(since))

    def snapshot(self) -> bool:
        """Cover all batches committed now by a new snapshot; False if there are none, or another writer was first."""
        before = self._snapshot()
        batches = self._batches(before)
        if not batches:
            return False
        number = before["number"] + 1
        mark = f"{number:08d}-{uuid.uuid4().hex[:12]}"
        fresh = self._load(list(batches.values()))
        known = self._load([before["latest"]] if before["latest"] else [])
        places = {"history": f"history/snapshot={mark}", "latest": f"latest/snapshot={mark}"}
        fresh.write.partitionBy(DATE).parquet(f"{self.root}/{places['history']}")
        self.newest(known.unionByName(fresh)).write.partitionBy(DATE).parquet(f"{self.root}/{places['latest']}")
        entry = {"number": number, "history": [*before["history"], places["history"]], "latest": places["latest"], "covers": [*before["covers"], *sorted(batches)]}
        return self.files.create_new(f"{self.root}/snapshots/{number:012d}", json.dumps(entry))
