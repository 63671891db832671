"""Results that are built anew only where their input has changed.

Rows are dealt into key buckets, and each bucket has a digest of its content: its number of rows and two sums of row
digests, whatever their order. A refresh compares the digests with those of the last one and builds the buckets that
differ; the others keep their folders. One pointer file names the model, the digests and the folder of every bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.publish import Rejected, digest_sums
from corpusmill.sources import store

BUCKET = "_bucket"


class BucketBuild:
    """A built table below one folder, which every executor can reach. One writer at a time; ``buckets`` is fixed by the first refresh."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 256):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.buckets = self.state().get("buckets", buckets)

    def state(self) -> dict:
        """{model, buckets, digests: {bucket: [n, high, low]}, folders: {bucket: version}}; empty before the first refresh."""
        text = store.read_text(self.spark, f"{self.root}/CURRENT")
        return json.loads(text) if text else {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def digests(self, rows: DataFrame, columns: list[str]) -> dict[str, list]:
        """Digest of every bucket that has rows, in one partial aggregate."""
        found = rows.withColumn(BUCKET, self.bucket()).groupBy(BUCKET).agg(*digest_sums(columns)).collect()  # one row a bucket
        return {str(r[BUCKET]): [r.n, r.high, r.low] for r in found}

    def refresh(self, rows: DataFrame, columns: list[str], model: str, build: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Builds what has changed in ``columns`` since the last refresh, everything for another model, and returns the buckets built.

        ``build`` gets the rows of the changed buckets with their number in ``_bucket``, which its result must keep. Buckets
        without rows any more are dropped. A refresh that fails leaves the last result.
        """
        state, now = self.state(), self.digests(rows, columns)
        known = state.get("digests", {}) if state.get("model") == model else {}
        changed = sorted(int(b) for b, digest in now.items() if known.get(b) != digest)
        folders = {b: v for b, v in state.get("folders", {}).items() if b in now}
        if changed:
            version = uuid.uuid4().hex
            built = build(rows.withColumn(BUCKET, self.bucket()).where(F.col(BUCKET).isin(changed)))
            if BUCKET not in built.columns:
                raise ValueError(f"the build must keep {BUCKET}")
            built.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/built/{version}")
            # A bucket whose rows build nothing has no folder.
            written = {name.split("=")[1] for name in store.folders(self.spark, f"{self.root}/built/{version}")}
            folders = {b: v for b, v in folders.items() if int(b) not in set(changed)} | dict.fromkeys(written, version)
            schema = built.drop(BUCKET).schema.json()
        else:
            schema = state.get("schema")
        store.replace_text(self.spark, f"{self.root}/CURRENT", json.dumps(
            {"model": model, "buckets": self.buckets, "digests": now, "folders": folders, "schema": schema}))
        return changed

    def read(self, model: str | None = None) -> DataFrame:
        """The result of the last refresh; refused if another model made it."""
        state = self.state()
        if not state.get("schema"):
            raise LookupError(f"nothing is built in {self.root}")
        if model is not None and state["model"] != model:
            raise Rejected(f"this was made by {state['model']}, not by {model}; refresh it")
        from pyspark.sql.types import StructType
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.root}/built/{v}/{BUCKET}={b}" for b, v in state["folders"].items()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def clean(self) -> int:
        """Deletes folders of buckets that newer ones replace, once no reader holds them."""
        kept, gone = {(v, b) for b, v in self.state().get("folders", {}).items()}, 0
        for version in store.folders(self.spark, f"{self.root}/built"):
            for name in store.folders(self.spark, f"{self.root}/built/{version}"):
                if (version, name.split("=")[1]) not in kept:
                    gone += store.delete(self.spark, f"{self.root}/built/{version}/{name}")
        return gone
