"""Helpers shared by the operators of this subpackage.

Large intermediate tables go to the folder that all executors share
(``spark.checkpoint.dir``); a folder of our own is used only where that setting is
unset, as in tests.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: ``[\x20\x09-\x0D]``; ``bytes.split()`` splits on the same six.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors. A folder of this machine serves only where all run on it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.startswith("local-") or not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, from files in the shared folder (lineage is cut)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder that live as long as one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    s = Scratch(spark)
    try:
        yield s
    finally:
        s.drop()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as double underscores) that hold inside the block."""
    old = {k: spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k.replace("__", "."))
            else:
                spark.conf.set(k.replace("__", "."), v)


def send(spark: SparkSession, value):
    """A broadcast of an object together with the code of its class, for workers without this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    return pickle.loads(shared.value)


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def slices(batches, rows: int = 1000):
    """Arrow batches of at most so many rows: what a worker holds at once does not follow Spark's batch size."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def give_back() -> None:
    """Freed memory that Arrow's pool and the C library keep for later goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run):
    """An Arrow function after which the worker gives memory back: it is kept for later tasks, and other tasks run meanwhile."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def fold_of(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


#: A key is heavy if it has more than one row in HEAVY, and more than LIGHT rows; so there are at most HEAVY heavy keys.
HEAVY, LIGHT = 2000, 1000


def looked_up(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with ``found`` on ``key``, without n: one row a key with n, how many of the ``total`` rows have it.

    Rows of heavy keys meet a broadcast of at most HEAVY rows, so no task gets all rows of a key.
    ``found`` should be cheap to read twice.
    """
    heavy = found.where(F.col("n") > max(LIGHT, total // HEAVY))
    if heavy.isEmpty():
        return rows.join(found.drop("n"), key)
    heavy = F.broadcast(heavy.drop("n"))
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(found.drop("n"), key))


def most_frequent(counts: DataFrame, most: int, cost: Column | None = None) -> DataFrame:
    """Rows of ``counts`` with the largest n, as many as ``cost`` (1 a row) adds up to at most ``most``; rows of about equal n go together."""
    grade = F.floor(F.log2("n") * 16).cast("int")
    taken, least = 0, None
    grades = counts.groupBy(grade.alias("g")).agg(F.sum(F.lit(1) if cost is None else cost).alias("cost")).orderBy(F.desc("g")).collect()
    for r in grades:
        if taken + r.cost > most:
            break
        taken, least = taken + r.cost, r.g
    return counts.where(F.lit(False) if least is None else grade >= least)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, as (node, component) with the smallest node as name.

    ``edges`` has two bigint columns ``u`` and ``v``. Alternates large-star and small-star
    contraction until nothing changes: only edges are shuffled; minima are combined before the
    shuffle, and the edges of a hub are looked up in a broadcast. Nodes without edges do not appear.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return cut(df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    e, mark = ordered(edges), None
    for _ in range(rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == now:
            break
        mark = now
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
        large = looked_up(both.where("v > u"), low, "u", 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = cut(large.where("u <> v").distinct())
        # small star: each node with its smaller neighbours, all tied to the smallest of them
        small_low = cut(big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = looked_up(big, small_low, "u", now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = ordered(small.union(small_low.select("u", F.col("m").alias("v"))))
    else:
        raise RuntimeError("components did not settle")
    ends = e.groupBy("u").agg(F.min("v").alias("component"))
    return cut(ends.select(F.col("u").alias("node"), "component").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


#: Bits of a bitmap that tells rows whose key may be in a set: at least, and at most (1 MB).
BITMAP_BITS, MOST_BITS = 1 << 20, 1 << 23


def perhaps_in(df: DataFrame, key: Column, keys: DataFrame, name: str = "perhaps", bits: int = BITMAP_BITS) -> DataFrame:
    """df with a boolean column: false where ``key`` is surely not in ``keys`` (a table with the one column).

    A bitmap of hashes is broadcast, so nothing is shuffled. It spares most rows a join; if the keys are
    so many that it fills up, all rows are marked and the join that follows does the work.
    """
    at_, word, bit_ = (f"__{x}_{uuid.uuid4().hex}" for x in ("at", "word", "bit"))
    at = F.pmod(F.xxhash64(key), F.lit(bits)).cast("int")
    k = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(bits)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)))
    words = keys.select(F.floor(k / 64).cast("int").alias(word), one.alias("b")).groupBy(word).agg(F.bit_or("b").alias(bit_))
    bit = F.call_function("shiftrightunsigned", F.col(bit_), F.pmod(F.col(at_), F.lit(64))).bitwiseAND(F.lit(1)) == 1
    placed = df.withColumn(at_, at).withColumn(word, F.floor(F.col(at_) / 64).cast("int"))
    return placed.join(F.broadcast(words), word, "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop(at_, word, bit_)


def bits_for(keys: int) -> int:
    """Bits of a bitmap for so many keys: about 16 a key, in bounds."""
    bits = BITMAP_BITS
    while bits < min(16 * keys, MOST_BITS):
        bits *= 2
    return bits


def keep_rows(docs: DataFrame, mark: Column, groups: DataFrame) -> DataFrame:
    """docs without the rows that ``groups`` drops: a row of (doc_id, mark, kept) for each row of docs.

    ``mark`` is the same function of a row of docs. Of rows with one id and mark, at most one is kept
    in groups; that with the smallest JSON form stays. Columns of docs may have any names. Only rows
    that may be dropped are shuffled.
    """
    odd = cut(groups.groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1 OR NOT kept").withColumn("both", F.xxhash64("doc_id", "mark")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"))
    asked = perhaps_in(rows, F.xxhash64("doc_id", "mark"), odd.select("both"), bits=bits_for(odd.count()))
    sure = asked.where("NOT perhaps").select("row")
    unsure = asked.where("perhaps").alias("r").join(odd.alias("o"), F.expr("r.doc_id <=> o.doc_id AND r.mark = o.mark"), "left")
    kept = unsure.where("o.kept IS NULL OR o.kept").groupBy("r.doc_id", "r.mark").agg(F.min_by("r.row", F.to_json("r.row")).alias("row")).select("row")
    return sure.union(kept).select("row.*")
