"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (a local test session) is a temporary folder used,
    and then the same one for the whole session.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("cyclespark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-cyclespark-")
        spark.conf.set("cyclespark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _folder(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    What follows neither recomputes ``df`` nor depends on one executor's disk. A
    Parquet table is preferred to ``checkpoint()``, which runs its last stage twice.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _note(path)
    return _folder(df, path)


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def _note(path: str) -> None:
    if (paths := _noted.get()) is not None:
        paths.append(path)


@contextmanager
def noting() -> Iterator[list[str]]:
    """The folders that operators called inside write, in this thread, less those that they remove."""
    paths: list[str] = []
    token = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in the shared store."""
    jvm, noted = spark.sparkContext._jvm, _noted.get()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if noted and path in noted:
            noted.remove(path)


#: Where a frame names the tables that it reads, in the metadata of its first column.
READS = "cyclespark.reads"


def naming(df: DataFrame, paths: list[str]) -> DataFrame:
    """``df``, whose schema names the intermediate tables that it reads. A Parquet copy of it names them too."""
    field = df.schema.fields[0]
    rest = {k: v for k, v in field.metadata.items() if k != READS}
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return df.select(F.col(quoted[0]).alias(field.name, metadata=rest | {READS: paths} if paths else rest), *quoted[1:])


def release(df: DataFrame) -> list[str]:
    """Remove the tables that ``df`` names but doesn't read: it is a written copy of what did. Those that it reads are returned.

    Names count only if they are of this session's shared folder and of the form that ``cut`` and ``Tables`` give. Spark frees
    the shuffle files of plans that nothing refers to any more when the driver's JVM collects garbage, so that is asked for as well.
    """
    spark = df.sparkSession
    form = re.compile(re.escape(shared_folder(spark)) + r"/[a-z0-9-]+-[0-9a-f]{32}")
    named = [p for p in df.schema.fields[0].metadata.get(READS, []) if isinstance(p, str) and form.fullmatch(p)] if df.schema.fields else []
    if named:
        read = {part for f in df.inputFiles() for part in f.split("/")}
        kept = [p for p in named if p.rsplit("/", 1)[-1] in read]
        remove(spark, [p for p in named if p not in kept])
        named = kept
    spark.sparkContext._jvm.System.gc()
    return named


class Tables:
    """The intermediate tables of one run of an operator, in a folder of their own.

    A table is dropped once all that reads it has been written itself, so a lost executor
    never needs it again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _note(self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return _folder(df, f"{self.path}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        """Several tables written as ``name/column=value``, as one."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        remove(self.spark, [f"{self.path}/{n}" for n in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Steps of doubling: arrays may have up to 2^DOUBLINGS entries.
DOUBLINGS = 26


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``values`` (an array) with each entry joined to all before it, in doubling steps: n log n work, no array grows by copying.

    ``join`` is associative, such as a sum or a maximum.
    """

    def step(x: Column, k: int) -> Column:
        reach = 1 << k
        wider = F.transform(x, lambda v, i: F.when(i >= reach, join(F.get(x, i - reach), v)).otherwise(v))
        return F.when(F.size(x) > reach, wider).otherwise(x)

    for k in range(DOUBLINGS):
        values = _bound(values, step, k)
    return values


def _bound(value: Column, body: Callable, k: int) -> Column:
    return let(value, lambda x: body(x, k))


def count_below(ordered: Column, limit: Column) -> Column:
    """How many entries of an ascending array are less than ``limit``, by bisection."""
    place = F.lit(0)
    for k in reversed(range(DOUBLINGS)):
        at = place
        place = _bound(at, lambda p, k: F.when(F.get(ordered, p + ((1 << k) - 1)) < limit, p + (1 << k)).otherwise(p), k)
    return place


#: Code points of a block, and of texts that aren't cut into blocks.
BLOCK, WHOLE = 1024, 4096


def blocks_of(text: Column) -> Column:
    """A text as (w, b): its width of blocks and the blocks, so that parts of long texts are cut out without walking from the start."""
    return F.struct(
        F.when(F.length(text) > WHOLE, F.lit(BLOCK)).otherwise(F.lit(1 << 30)).alias("w"),
        F.when(F.length(text) > WHOLE, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array(text)).alias("b"),
    )


def part_of(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` code points of a text from ``start`` (from 0) on, from its ``blocks_of``."""
    first = F.floor(start / blocks["w"]).cast("int")
    last = F.floor((start + length) / blocks["w"]).cast("int")
    return F.substring(F.array_join(F.slice(blocks["b"], first + 1, last - first + 1), ""), start - first * blocks["w"] + 1, length)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def salted_left_join(big: DataFrame, small: DataFrame, keys: list[str], on_row: list[str], salts: int) -> DataFrame:
    """Left join on null-safe ``keys`` that spreads each key of ``big`` over ``salts`` tasks.

    ``small`` has one row a key and is repeated once for each salt; ``on_row`` are the
    columns of ``big`` whose hash deals its rows out. Clashing names in ``small`` other
    than the keys must have been renamed.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*on_row), F.lit(salts)).cast("int"))
    right = small.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[c for c in small.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt_r"),
    )
    on = F.col("_salt") == F.col("_salt_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right, on, "left").drop("_salt", "_salt_r", *[f"_k_{k}" for k in keys])


def may_hold(ids: DataFrame, key: str, slots: int = 1 << 22) -> Callable[[Column], Column]:
    """A test for values of the type of ``key``: false only for those that no row of ``ids`` has there.

    It reads a map of ``slots`` bits, so its size is fixed; the more ids, the more others share a bit with one.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)))
    bits = ids.select(slot(key).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(bit(F.col("s"))).alias("bits"))
    words = ids.sparkSession.range(slots // 64).withColumnRenamed("id", "w").join(bits, "w", "left").select("w", F.coalesce("bits", F.lit(0)).alias("bits"))
    bitmap = words.agg(F.sort_array(F.collect_list(F.struct("w", "bits")))["bits"].alias("b")).scalar()
    return lambda c: bit(slot(c)).bitwiseAND(F.get(bitmap, F.shiftright(slot(c), 6))) != 0


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores in front as make it differ from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
