"""State looked up by key, in runs of hash buckets.

Rows with a text ``key`` lie in runs, each written by one batch under its own number and
never changed. A run is divided into buckets by the leading bits of the key's hash, as many
as its size asks for, so a batch reads only the buckets that its keys fall in: at most one of
bounded size per key and run. Adding rows writes a new run; trailing runs that are not twice
as large as what is written are taken up into it, so there are few runs (about the logarithm
of the number of batches) and a row is rewritten as seldom. Buckets of a merged run are
written anew, which compacts them.

Which runs are alive is a list that the caller keeps with its batch's mark. A batch that is
repeated starts from the same list and replaces its own run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from carelake.streaming.store import read_if_there

#: Rows of a bucket, about; and how many bits of the hash may name one.
BUCKET_ROWS = 50_000
MAX_BITS = 12


def _bucket(bits: int):
    return (F.shiftrightunsigned(F.xxhash64("key"), 64 - bits) if bits else F.lit(0)).cast("int")


def bits_for(rows: int) -> int:
    """How many bits divide ``rows`` into buckets of about ``BUCKET_ROWS``."""
    return min(MAX_BITS, max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


@dataclass
class KeyedState:
    """The runs ``[{"run": name, "bits": b, "rows": n}, ...]`` of one state under ``folder``;
    ``schema`` has a text column ``key``."""

    spark: SparkSession
    folder: str
    schema: StructType
    runs: list[dict]

    def _read(self, run: dict, buckets: list[int] | None = None) -> DataFrame:
        """A run, or some of its buckets (one that has no rows has no folder); only their
        folders are listed."""
        inside = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        path = f"{self.folder}/{run['run']}"
        if not run["bits"] or buckets is None or 2 * len(buckets) > 1 << run["bits"]:
            return self.spark.read.schema(inside).parquet(path)
        some = f"{path}/bucket={{{','.join(map(str, buckets))}}}"
        return read_if_there(lambda: self.spark.read.schema(inside).option("basePath", path).parquet(some),
                             lambda: self.spark.createDataFrame([], inside))

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema) if not frames else frames[0].select(*self.schema.fieldNames())
        for f in frames[1:]:
            out = out.unionByName(f.select(*self.schema.fieldNames()))
        return out

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that ``keys`` (a column ``key``) fall in; the rows of other
        keys in them come along. Only bucket numbers reach the driver."""
        bits = max((r["bits"] for r in self.runs), default=0)
        hit = {r[0] for r in keys.select(_bucket(bits)).distinct().collect()} if bits else {0}
        found = []
        for run in self.runs:
            found.append(self._read(run, sorted({b >> (bits - run["bits"]) for b in hit})))
        return self._union(found)

    def held(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among ``keys``."""
        return self.near(keys).join(keys.select("key").distinct(), "key", "left_semi")

    def added(self, name: str, n: int) -> tuple[list[dict], list[dict]]:
        """(runs alive after a run ``name`` with ``n`` new rows, runs that it takes up)."""
        alive, taken = list(self.runs), []
        while alive and alive[-1]["rows"] < 2 * n:
            taken.append(alive.pop())
            n += taken[-1]["rows"]
        return [*alive, {"run": name, "bits": bits_for(n), "rows": n}], taken

    def write(self, rows: DataFrame, runs: list[dict], taken: list[dict]) -> None:
        """Write the last of ``runs``: ``rows`` and those of the runs ``taken`` up."""
        new = runs[-1]
        every = self._union([rows, *[self._read(r) for r in taken]])
        # a bucket of many equal keys is split over files; small ones share a task
        dealt = every.withColumn("bucket", _bucket(new["bits"]))
        dealt = dealt.hint("rebalance", "bucket") if new["bits"] else dealt.coalesce(1)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{new['run']}")
