"""Records by key that change in batches: a base, newer deltas, and compaction.

Each batch is written as a delta of its own folder, dealt into key buckets; a batch that runs again replaces itself.
Compaction folds finished deltas into the base, but only in the buckets that they touch; a pointer file then says which
folder holds each bucket and up to which batch deltas are folded. Readers take the base and the newer deltas only, so
what they read follows the number of keys and not the number of batches. Deletions are records (tombstones).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.dedupe import latest
from corpusmill.sources import store

BATCH, DELETED, BUCKET = "_batch", "_deleted", "_bucket"


class KeyedTable:
    """Rows of ``schema`` by ``keys`` below one folder, which every executor can reach. One writer at a time.

    With ``order``, the row with the highest order value counts for each key, on equal order the one of the later batch (and in one
    batch the larger row). Without, a key has any number of rows, and those of the last batch that names it count: its
    children are replaced as a whole. Keys may be null; a null key is a key.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, keys: list[str], order: str | None = None, buckets: int = 64):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), keys, order
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(DELETED, T.BooleanType())])
        self.buckets = self.state().get("buckets", buckets)

    # ---- state

    def state(self) -> dict:
        """{upto: last folded batch, base: {bucket: version}, buckets}; empty before the first compaction."""
        text = store.read_text(self.spark, f"{self.root}/CURRENT")
        return json.loads(text) if text else {}

    def upto(self) -> int:
        return self.state().get("upto", -1)

    def finished(self) -> list[int]:
        """Batches whose delta is written in full and not folded yet."""
        upto, found = self.upto(), []
        for name in store.folders(self.spark, f"{self.root}/deltas"):
            batch = int(name.split("=")[1])
            if batch > upto and store.exists(self.spark, f"{self.root}/deltas/{name}/_SUCCESS"):
                found.append(batch)
        return sorted(found)

    # ---- writing

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch: int, deleted: Column | None = None) -> bool:
        """Adds a batch of records; where ``deleted`` holds, the key goes. Returns False where the batch is folded already, as
        when a stream repeats it; nothing changes then. Of several rows of a key that order ranks, one is kept."""
        if batch <= self.upto():
            return False
        told = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        marked = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(batch).cast("long").alias(BATCH), told.alias(DELETED))
        if self.order:
            marked = self.current(marked)
        self.deal(marked, f"{self.root}/deltas/batch={batch}")
        return True

    def remove(self, keys: DataFrame, batch: int, at: Column | None = None) -> bool:
        """Deletes the keys of ``keys``; with an order, as of ``at``: records with a higher order value stay or come back."""
        if self.order and at is None:
            raise ValueError("a deletion among ordered records needs the order value it happens at")
        filled = keys.select(*[F.col(f.name) if f.name in self.keys else (at if f.name == self.order else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in self.schema])
        return self.write(filled, batch, F.lit(True))

    def deal(self, rows: DataFrame, path: str) -> None:
        # Rebalancing makes one file of a small bucket and several of a large one, also where one key holds most of it.
        rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)

    def compact(self) -> int:
        """Folds the finished batches into the base and returns their number. Only buckets that they touch are read and written;
        tombstones stay as records, since older batches may still come. The old base and the folded deltas stay until ``clean``."""
        batches = self.finished()
        if not batches:
            return 0
        state, version = self.state(), uuid.uuid4().hex
        base = dict(state.get("base", {}))
        touched = sorted({name.split("=")[1] for b in batches for name in store.folders(self.spark, f"{self.root}/deltas/batch={b}")})
        paths = [f"{self.root}/deltas/batch={b}/{BUCKET}={k}" for b in batches for k in touched
                 if store.exists(self.spark, f"{self.root}/deltas/batch={b}/{BUCKET}={k}")]
        paths += [f"{self.root}/base/{base[k]}/{BUCKET}={k}" for k in touched if k in base]
        if paths:
            self.deal(self.current(self.load(paths)), f"{self.root}/base/{version}")
            base |= dict.fromkeys(touched, version)
        store.replace_text(self.spark, f"{self.root}/CURRENT", json.dumps({"upto": batches[-1], "base": base, "buckets": self.buckets}))
        return len(batches)

    def clean(self) -> int:
        """Deletes folded deltas and bases that no bucket lies in any more, once no reader holds them. Returns how many folders."""
        state, gone = self.state(), []
        used, upto = set(state.get("base", {}).values()), state.get("upto", -1)
        gone += [f"{self.root}/base/{v}" for v in store.folders(self.spark, f"{self.root}/base") if v not in used]
        gone += [f"{self.root}/deltas/{d}" for d in store.folders(self.spark, f"{self.root}/deltas") if int(d.split("=")[1]) <= upto]
        for path in gone:
            store.delete(self.spark, path)
        return len(gone)

    # ---- reading

    def paths(self) -> list[str]:
        """Folders a reader takes: the bucket folders of the base and the deltas that are newer."""
        state = self.state()
        return ([f"{self.root}/base/{v}/{BUCKET}={k}" for k, v in state.get("base", {}).items()]
                + [f"{self.root}/deltas/batch={b}" for b in self.finished()])

    def load(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).option("recursiveFileLookup", "true").parquet(*paths)

    def current(self, rows: DataFrame) -> DataFrame:
        """Of stored rows, those that count, tombstones among them."""
        if self.order:
            return latest(rows, self.keys, [self.order, BATCH, DELETED])
        newest = rows.groupBy(*self.keys).agg(F.max(BATCH).alias("_newest"))
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}"))
        return rows.alias("r").join(newest.alias("n"), on & (F.col(f"r.{BATCH}") == F.col("n._newest")), "left_semi").select(self.stored.names)

    def read(self) -> DataFrame:
        """The rows that count now."""
        return self.current(self.load(self.paths())).where(~F.col(DELETED)).select(self.schema.names)
