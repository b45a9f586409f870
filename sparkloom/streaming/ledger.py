"""A sink that writes each batch once, and that may fail without stopping the stream.

Every batch goes to a folder of its own, then to the ledger: how many rows were
written, or dropped because the write failed. A batch that is run again after
a crash finds its entry and writes nothing; one that had begun but has no
entry writes its folder anew. Only batches of the ledger are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import exists

WRITTEN, DROPPED = "WRITTEN", "DROPPED"
ENTRY = "batch long, state string, n long, error string"


def put_once(rows: DataFrame, batch: int, path: str, write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Writes a batch unless the ledger has it; the state that the ledger then tells.

    ``write`` puts rows at a place; what it raises is counted, not raised. A
    batch that was dropped stays dropped: a side track must not come back to
    hold up the stream.
    """
    spark = rows.sparkSession
    entry = f"{path}/ledger/{batch}"
    if exists(spark, f"{entry}/_SUCCESS"):
        return spark.read.schema(ENTRY).parquet(entry).first()["state"]
    rows = rows.persist()
    try:
        n, state, error = rows.count(), WRITTEN, None
        try:
            (write or _parquet)(rows, f"{path}/data/{batch}")
        except Exception as e:  # noqa: BLE001 - whatever the sink does, the stream goes on
            state, error = DROPPED, f"{type(e).__name__}: {e}"[:500]
    finally:
        rows.unpersist()
    told = [F.lit(batch).cast("long").alias("batch"), F.lit(state).alias("state"), F.lit(n).cast("long").alias("n"), F.lit(error).cast("string").alias("error")]
    spark.range(1).select(*told).coalesce(1).write.mode("overwrite").parquet(entry)
    return state


def _parquet(rows: DataFrame, place: str) -> None:
    rows.write.mode("overwrite").parquet(place)


def run(stream: DataFrame, path: str, shape: Callable[[DataFrame], DataFrame] | None = None, write: Callable[[DataFrame, str], None] | None = None, mode: str = "append") -> None:
    """All that is there now, batch by batch, through ``shape`` into the ledger's folder."""
    from .flows import rocksdb

    def put(rows: DataFrame, batch: int) -> None:
        put_once(rows if shape is None else shape(rows), batch, path, write)

    with rocksdb(stream.sparkSession):
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: batch, state, n, error."""
    return spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(f"{path}/ledger")


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that the ledger tells are written."""
    done = [r["batch"] for r in entries(spark, path).where(F.col("state") == WRITTEN).select("batch").collect()]  # a row per batch
    found = [p for p in (f"{path}/data/{b}" for b in sorted(done)) if exists(spark, p)]
    return spark.read.schema(schema).parquet(*found) if found else spark.range(0, 0, 1, 1).selectExpr("cast(null as int) as none").drop("none").to(_struct(schema))


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)
