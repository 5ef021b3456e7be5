"""A store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small shards (Parquet files). Compaction groups shards below the target into
tiers of similar size, and where a tier has ``fanout`` or more, merges them, in order of arrival, into
shards of up to the target size; each merge is one task over files whose sizes are known, so no data
is shuffled. A version is a manifest that lists the shards. It is written to a file of its own and
renamed to the next number, which fails if another writer took that number first: a commit is there as
a whole or not at all, readers keep their version, and a failed writer leaves only files that no
manifest names. ``vacuum`` deletes those once they are older than a grace period, within which a writer
must commit; a commit whose files are gone nevertheless is refused. The rename is atomic on HDFS and
local file systems; on an object store without such a rename the draft is created in place, if absent
(``create_if_absent=True``), where the store's file system has that.

A manifest has one entry per shard, so it grows with the data divided by the target size.
Defined cases: an empty arrival adds no shard but is a version; rows of any values, repeated or null,
are kept as they are; a schema other than the store's raises ValueError; an empty store reads as an
empty table.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

TARGET = 128 << 20
LEAST = 1 << 20
FANOUT = 4
GRACE = 24 * 3600.0  # seconds within which a writer commits what it wrote


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, least: int = LEAST, fanout: int = FANOUT, create_if_absent: bool = False):
        self.spark, self.path, self.target, self.least, self.fanout = spark, path.rstrip("/"), target, least, fanout
        self.create_if_absent = create_if_absent
        self.fs, _ = common.filesystem(spark, path)

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        folder = self._p("manifest")
        if not self.fs.exists(folder):
            return []
        names = (x.getPath().getName() for x in self.fs.listStatus(folder))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"file", "bytes", "tier"}]}; version 0 is the empty store."""
        versions = self.versions()
        version = (versions[-1] if versions else 0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._p(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, schema, shards: list[dict]) -> dict:
        """The next version, or FileExistsError if another writer has made it."""
        made = {"version": base["version"] + 1, "schema": schema, "shards": shards}
        before = {s["file"] for s in base["shards"]}
        if gone := [s["file"] for s in shards if s["file"] not in before and not self.fs.exists(self._p(s["file"]))]:
            raise FileNotFoundError(f"written files are gone, as the commit came after the grace period: {gone[:3]}")
        if self.create_if_absent:
            final = self._p(f"manifest/v{made['version']:08d}.json")
            try:
                out = self.fs.create(final, False)
                out.write(json.dumps(made).encode())
                out.close()
            except Exception as e:
                if self.fs.exists(final):
                    raise FileExistsError(str(final)) from e
                raise
            return made
        draft = self._p(f"draft/{uuid.uuid4().hex}.json")
        out = self.fs.create(draft, False)
        out.write(json.dumps(made).encode())
        out.close()
        final = self._p(f"manifest/v{made['version']:08d}.json")
        self.fs.mkdirs(final.getParent())
        jvm, gateway = self.spark._jvm, self.spark._sc._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, options)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise FileExistsError(str(final)) from e
            raise
        return made

    def _written(self, folder: str) -> list[dict]:
        found = sorted((x.getPath().getName(), x.getLen()) for x in self.fs.listStatus(self._p(folder)) if x.getPath().getName().endswith(".parquet"))
        return [{"file": f"{folder}/{name}", "bytes": size, "tier": self.tier(size)} for name, size in found]

    def tier(self, size: int) -> int:
        """0 up to the least size, then one more for each power of the fanout."""
        return 0 if size <= self.least else 1 + int(math.log(size / self.least, self.fanout))

    def append(self, df: DataFrame) -> dict:
        """Writes an arrival as new shards and commits it, again on top of versions that come between."""
        schema = json.loads(df.schema.json())
        for field in schema["fields"]:
            field["nullable"] = True
        folder = f"data/{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{folder}")
        return self._add(schema, self._filled(self._written(folder)))

    def append_all(self, df: DataFrame, arrival: str) -> Iterator[dict]:
        """Arrivals that come in one table, told apart by a column of few values: written in one pass, committed one by one.

        After each commit the caller may compact. The column itself is not kept; a null is an arrival, too.
        """
        own = df.drop(arrival)
        schema = json.loads(own.schema.json())
        for field in schema["fields"]:
            field["nullable"] = True
        folder = f"data/{uuid.uuid4().hex[:12]}"
        df.write.partitionBy(arrival).parquet(f"{self.path}/{folder}")
        parts = sorted(x.getPath().getName() for x in self.fs.listStatus(self._p(folder)) if "=" in x.getPath().getName())
        for part in parts:  # all rows of a file are of its arrival, so none is empty
            yield self._add(schema, self._written(f"{folder}/{part}"))

    def _add(self, schema: dict, new: list[dict]) -> dict:
        while True:
            base = self.manifest()
            if base["schema"] not in (None, schema):
                raise ValueError("the arrival's schema is not the store's")
            try:
                return self._commit(base, schema, base["shards"] + new)
            except FileExistsError:
                continue

    def _filled(self, shards: list[dict]) -> list[dict]:
        """Without files that have no rows; small ones are looked at together."""
        small = [s for s in shards if s["bytes"] <= 64 << 10]
        if not small:
            return shards
        there = self.spark.read.parquet(*[f"{self.path}/{s['file']}" for s in small]).select(F.input_file_name().alias("f")).distinct().collect()
        names = {r.f.rpartition("/")[2] for r in there}  # at most one row a file of this arrival
        return [s for s in shards if s["bytes"] > 64 << 10 or s["file"].rpartition("/")[2] in names]

    def plan(self, manifest: dict) -> list[list[dict]]:
        """Merges that are due: shards of one tier below the target, in order, up to the target in size."""
        tiers: dict[int, list[dict]] = {}
        for shard in manifest["shards"]:
            if shard["bytes"] < self.target // 2:
                tiers.setdefault(shard["tier"], []).append(shard)
        out = []
        for _, shards in sorted(tiers.items()):
            if len(shards) < self.fanout:
                continue
            group, size = [], 0
            for shard in shards:
                if group and size + shard["bytes"] > self.target:
                    out.append(group)
                    group, size = [], 0
                group.append(shard)
                size += shard["bytes"]
            if len(group) > 1:
                out.append(group)
        return [g for g in out if len(g) > 1]

    def compact(self, at_once: int = 8) -> dict:
        """Merges what is due, tier after tier, and commits after each round. Gives the last manifest."""
        while due := self.plan(base := self.manifest()):
            kind = StructType.fromJson(base["schema"])

            def merge(group: list[dict], kind=kind) -> list[dict]:
                folder = f"data/{uuid.uuid4().hex[:12]}"
                self.spark.read.schema(kind).parquet(*[f"{self.path}/{s['file']}" for s in group]).coalesce(1).write.parquet(f"{self.path}/{folder}")
                return self._written(folder)

            with ThreadPoolExecutor(at_once) as pool:
                made = list(pool.map(merge, due))
            while True:
                now = self.manifest()
                there = {s["file"] for s in now["shards"]}
                instead = {g[0]["file"]: m for g, m in zip(due, made, strict=True) if all(s["file"] in there for s in g)}
                gone = {s["file"] for g in due if g[0]["file"] in instead for s in g}
                shards = [x for s in now["shards"] for x in (instead.get(s["file"], []) if s["file"] in gone else [s])]
                try:
                    self._commit(now, now["schema"], shards)
                    break
                except FileExistsError:
                    continue
        return base

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["schema"]:
            return self.spark.createDataFrame([], StructType())
        kind = StructType.fromJson(found["schema"])
        if not found["shards"]:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{s['file']}" for s in found["shards"]])

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> None:
        """Deletes all but the last ``keep`` versions, and files older than ``grace`` seconds that no version left names.

        A file's age counts from its last change by the store's clock, so a writer that has not committed
        yet keeps its files. Readers of an older version than those kept lose theirs.
        """
        versions = self.versions()
        for v in versions[:-keep]:
            self.fs.delete(self._p(f"manifest/v{v:08d}.json"), False)
        named = {s["file"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        if not self.fs.exists(self._p("data")):
            return
        before = 1000 * (time.time() - grace)
        found = self.fs.listFiles(self._p("data"), True)
        top = self.fs.makeQualified(self._p("data")).toString()
        while found.hasNext():
            x = found.next()
            name = "data" + x.getPath().toString().removeprefix(top)
            if name not in named and x.getModificationTime() < before:
                self.fs.delete(x.getPath(), False)
