"""A table of Parquet files by key bucket, of which a batch rewrites only those it touches.

    table = BucketedTable(spark, path, ["issuer", "owner"], buckets=64)
    stream.writeStream.foreachBatch(table.merging("trades", combine)).option("checkpointLocation", ...).start()

A version is a small JSON manifest: for each bucket the folders of its files, and for each stream the last batch it has taken.
A merge reads the touched buckets, combines them with the batch, writes new folders and then the next manifest, which must not exist yet; until
then readers see the version before. A batch id that a stream has already given is without effect, so a batch that is run again after a failure counts once.
Old versions stay readable until `expire`. One writer at a time: of two that write the same version the second gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
#: (old rows of the touched buckets, batch, number of the version that is made) -> rows.
Combine = Callable[[DataFrame, DataFrame, int], DataFrame]


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    # ---- manifests, a few KB each, by the session's file system ----

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """folders by bucket, batches by stream, and the schema; of the newest version unless one is asked for."""
        known = self.versions()
        if version is None and not known:
            return {"version": -1, "folders": {}, "batches": {}, "schema": None}
        version = known[-1] if version is None else version
        fs, p = self._at(f"{self.path}/manifest/v{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, draft = self._at(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._at(f"{self.path}/manifest/v{manifest['version']}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another")

    # ---- rows ----

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/data/{f}" for b in buckets for f in manifest["folders"].get(b, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default); an error before the first merge."""
        manifest = self.manifest(version)
        rows = self._rows(manifest, list(manifest["folders"]))
        if rows is None:
            raise ValueError(f"{self.path} has no version yet")
        return rows

    def merge(self, batch: DataFrame, combine: Combine, stream: str = "", batch_id: int | None = None) -> bool:
        """Let combine(old rows, batch, version) stand for the rows of the buckets that the batch touches. The result must keep rows in their buckets (by key). False if this batch was taken before."""
        now = self.manifest()
        if batch_id is not None and batch_id <= now["batches"].get(stream, -1):
            return False
        # At most as many numbers as there are buckets.
        touched = sorted(str(r[0]) for r in batch.select(self.bucket().alias("b")).distinct().collect())
        old = self._rows(now, touched)
        version = now["version"] + 1
        after = combine(batch.limit(0) if old is None else old, batch, version)
        folder = f"v{version}-{uuid.uuid4().hex}"
        if touched:
            # Rebalanced by bucket: a small bucket is one file, a large one several.
            after.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        written = {n.partition("=")[2] for n in self._names(f"data/{folder}") if n.startswith(f"{BUCKET}=")}
        if not written <= set(touched):
            raise ValueError("a merge moved rows to buckets that the batch does not touch")
        folders = {b: f for b, f in now["folders"].items() if b not in touched} | {b: [f"{folder}/{BUCKET}={b}"] for b in sorted(written)}
        batches = now["batches"] | ({stream: batch_id} if batch_id is not None else {})
        self._publish({"version": version, "folders": folders, "batches": batches, "schema": json.loads(after.schema.json())})
        return True

    def merging(self, stream: str, combine: Combine) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function for a stream of this name."""

        def apply(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, combine, stream, batch_id)

        return apply

    def expire(self, keep: int = 1) -> int:
        """Forget all but the newest `keep` versions and remove folders that none of those has; how many folders went."""
        known = self.versions()
        for v in known[: max(0, len(known) - keep)]:
            fs, p = self._at(f"{self.path}/manifest/v{v}.json")
            fs.delete(p, False)
        used = {f.split("/")[0] for v in self.versions() for fs_ in self.manifest(v)["folders"].values() for f in fs_}
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            fs, p = self._at(f"{self.path}/data/{n}")
            fs.delete(p, True)
        return len(gone)


# ---- ways to combine ----


def upserting(keys: list[str]) -> Combine:
    """The batch's rows take the place of old ones of equal key."""

    def combine(old: DataFrame, new: DataFrame, _: int) -> DataFrame:
        return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)

    return combine


def applying_changes(key: str, seq: str) -> Combine:
    """The batch is a change log (op: upsert or delete); the last change of each key, by seq, counts."""
    from quillfin.operators.relational import apply_changes

    def combine(old: DataFrame, log: DataFrame, _: int) -> DataFrame:
        columns = [c for c in log.columns if c not in ("op", seq)]
        return apply_changes(old.select(*columns), log, key, seq).select(*columns)

    return combine


def amending(keys: tuple[str, ...], order: str) -> Combine:
    """Filings whose amendments take the place of what came before them, in the order of arrival: batch by batch, within one by `order`."""
    from quillfin.operators.insider import amended

    def combine(old: DataFrame, new: DataFrame, version: int) -> DataFrame:
        come = new.withColumn("arrival", F.struct(F.lit(version).cast("long").alias("version"), F.col(order).alias("place")))
        return amended(old.unionByName(come, allowMissingColumns=True), keys, order="arrival")

    return combine
