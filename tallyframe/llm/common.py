"""Helpers shared by the text operators."""

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import fresh_dir, remove_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not use yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives a lost executor.

    ``compression`` is a Parquet codec; without one the session's is used.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting by which the shuffle files of a query go when it has ended, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Large intermediate tables of one call of an operator, held no longer than they are read.

    Writing one frees the shuffle files that made it, since from then on the table is read in
    their place; ``drop`` deletes tables whose readers have been written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = fresh_dir(self.spark, name)
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_dir(self.spark, self.paths.pop(name))


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


#: Rows and bytes of texts that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batches to a size for whole texts; smaller settings stay.

    The defaults suit rows of a few numbers. Ten thousand texts with all that an operator
    makes of them are hundreds of MB in every worker.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


_HELD: dict = {}


def kept_by_worker(key: tuple, make: Callable):
    """What a worker keeps between batches and tasks: one object, the last asked for.

    Workers live on from operator to operator; with one place for all of them, what an
    earlier operator remembered does not add to what the next one needs.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def struct_udf(row_fn: Callable[[], Callable[[str], tuple]], fields: Iterable[tuple[str, str]], ddl: str):
    """An Arrow UDF from text to a struct.

    ``row_fn()`` is called once per batch stream and returns the function of one text
    (NULL arrives as the empty text); ``fields`` name the Arrow types of its results.
    """
    names = [n for n, _ in fields]
    kinds = [ARROW[k] for _, k in fields]

    @F.arrow_udf(ddl)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = row_fn()
        for batch in batches:
            rows = [one(v or "") for v in batch.to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return apply


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}
