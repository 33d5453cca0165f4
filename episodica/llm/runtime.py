"""What every operator of this subpackage needs from the session: code on the workers, batch sizes, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import U64, mix

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows in one Arrow batch. Texts may be long, so batches hold few of them.
BATCH_ROWS = 1000
#: Bits of a map of ids.
MAP_BITS = 23


#: Shuffle files of an execution go at its end: nobody reads them once the table is written.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For Python workers: arrays of 4 MB and more go back to the system when they are freed, and arenas are few.
_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 22), "MALLOC_TRIM_THRESHOLD_": str(1 << 25), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, give memory back, and keep Arrow batches small."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    for name, value in _MEMORY.items():
        environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the cluster names none (tests), a temporary one is set."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="episodica-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Tables under the shared folder: a written table survives lost executors and cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame, *, thin: bool = False) -> DataFrame:
        """df as a written table. thin: its rows are a few numbers and little work, so partitions are joined for fewer files."""
        self.made += 1
        if thin:
            most = partitions(self.spark)
            df = df.coalesce(max(min(most, 16), most // 8))
        path = f"{self.path}/{self.made}"
        before = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        made = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
        made._scratch_path = path
        return made

    def keep(self, *tables: DataFrame) -> None:
        """Drop all but these tables: what is made from here on reads no other."""
        kept = {t._scratch_path for t in tables}
        for path in (f"{self.path}/{k}" for k in range(1, self.made + 1)):
            if path not in kept:
                remove(self.spark, path)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, table._scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def id_crc32(column: str = "doc_id"):
    """crc32 of an id written as text: what decides which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def id_map(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed id: a set of ids in fixed space. An id that is missing from it isn't among them."""

    def run(batches):
        out = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            out[_slots(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64))] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(np.packbits(out).tobytes(), 1)], pa.binary())})

    out = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    for row in ids.where("id is not null").select("id").coalesce(8).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) >> U64(64 - MAP_BITS)).astype(np.int64)


def picker(spark: SparkSession, bits: np.ndarray, inside: bool, id_col: str = "id"):
    """batch -> its rows whose id is (or isn't) in the map; rows without id are none of either. For use within a task."""
    known = spark.sparkContext.broadcast(bits)  # of fixed size

    def pick(batch):
        have, ids = known.value, batch.column(id_col)
        slots = _slots(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        keep = ((have[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1) == inside) & ids.is_valid().to_numpy(zero_copy_only=False)
        return batch.filter(pa.array(keep))

    return pick


def picked(docs: DataFrame, bits: np.ndarray, inside: bool, id_col: str = "id") -> DataFrame:
    """The documents whose id is (or isn't) in the map. Rows without id are none of either."""
    pick = picker(docs.sparkSession, bits, inside, id_col)

    def run(batches):
        for batch in batches:
            if (part := pick(batch)).num_rows:
                yield part

    return docs.mapInArrow(run, docs.schema)
