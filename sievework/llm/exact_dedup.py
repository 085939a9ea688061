"""Exact deduplication with disk-backed streaming state.

Each row's white-space-normalised text gets a SHA-256 digest. The fingerprints (digest, stable
identifier, locator of the content) are streamed through an aggregation whose state is kept by
digest in RocksDB, without a watermark, so it never expires: the state holds the digest, the
smallest identifier, that row's locator and the count. Partial aggregation before the shuffle
keeps a hot text from meeting in one task. A hit is believed only after its full bytes are
checked: within each digest that occurs twice or more, the smallest and the largest text must
be the same bytes; digests where they differ are split by their texts.

The state lives as long as the call, or in a folder that the caller names: then later calls go on from it,
and a text seen in an earlier call is kept there, not again. Of texts of earlier calls the digest is believed.

Defined cases: null text counts as empty, and all empty texts are one group; of repeated rows with
the same identifier exactly one is kept; a null identifier sorts first; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import SPACE_CLASS, bits_for, cut, keep_rows, looked_up, perhaps_in, scratch, settings

STATE = {
    "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true",
    "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true",
    "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": "200",
    "spark__sql__streaming__stateStore__rocksdb__allowFAllocate": "false",
    "spark__sql__streaming__noDataMicroBatches__enabled": "false",
}


def normalised(col: str = "text") -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), SPACE_CLASS + "+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _stream(spark: SparkSession, schema, at: str) -> DataFrame:
    """Runs the new fingerprints in at/prints through the keyed state; gives the state: digest, first, n, group_size."""
    changes = f"{at}/changes"
    with settings(spark, **STATE):
        state = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", max(64, 8 * spark.sparkContext.defaultParallelism)).parquet(f"{at}/prints")
            .groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("first"), F.count("*").alias("n"))
        )
        run = (
            state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{changes}/batch={batch}")).start()
        )
        run.awaitTermination()
    try:
        seen = spark.read.parquet(changes)
    except AnalysisException as e:  # no micro-batch ran: the table was empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = spark.createDataFrame([], "digest string, first struct<doc_id:long,locator:string>, n long, batch int")
    return cut(seen.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n")).withColumn("group_size", F.col("n")))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, keep_locator.

    ``digest`` is the fingerprint of the normalised text; results are exact for any function. ``state``: a
    folder that all executors share, where the state stays for later calls.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"), F.input_file_name().alias("file"))
    with scratch(spark) as tmp:
        run = uuid.uuid4().hex
        locator = F.concat_ws("#", "file", F.lit(run), F.monotonically_increasing_id().cast("string")).alias("locator")
        at = tmp.root if state is None else state
        prints = base.select("doc_id", digest(F.col("norm")).alias("digest"), (sha256(F.col("norm")) if digest is not sha256 else F.lit(None).cast("string")).alias("text_sha256"), locator)
        prints.write.mode("append").parquet(f"{at}/prints")
        known = _stream(spark, prints.schema, at)
        mine = spark.read.schema(prints.schema).parquet(f"{at}/prints").where(F.col("locator").contains(f"#{run}#")).withColumn("text_sha256", F.coalesce("text_sha256", "digest"))
        if state is not None:  # counts of the rows of this call, which the join below meets
            known = cut(known.drop("n").join(mine.groupBy("digest").agg(F.count("*").alias("n")), "digest"))
        total = mine.count()
        torn = cut(_unequal(base, known, digest))
        out = looked_up(mine, known, "digest", total).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("first.locator")).alias("kept"), "text_sha256", F.col("first.locator").alias("keep_locator"), "digest")
        if not torn.isEmpty():
            out = out.join(torn, "digest", "left_anti").unionByName(_by_text(base, torn, digest))
        return cut(out.drop("digest"))


def _unequal(base: DataFrame, state: DataFrame, digest) -> DataFrame:
    """Digests with more than one text. Only texts whose digest may be a hit are compared."""
    hits = state.where("n > 1").select("digest")
    maybe = perhaps_in(base.withColumn("digest", digest(F.col("norm"))), F.col("digest"), hits, bits=bits_for(hits.count())).where("perhaps")
    return maybe.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("z")).where("a <> z").select("digest")


def _by_text(base: DataFrame, torn: DataFrame, digest) -> DataFrame:
    """The rows of digests that stand for several texts, grouped by the texts themselves."""
    own = cut(base.withColumn("digest", digest(F.col("norm"))).join(torn, "digest", "left_semi").withColumn("rid", F.monotonically_increasing_id()))
    groups = own.groupBy("digest", "norm").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("n"))
    return own.join(groups, ["digest", "norm"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), sha256(F.col("norm")).alias("text_sha256"), F.lit(None).cast("string").alias("keep_locator"), "digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each text, that with the smallest id; the columns stay as they are.

    Of rows with one id and equal texts the one with the smallest JSON form stays.
    """
    return keep_rows(docs, sha256(normalised()), exact_groups(docs).select("doc_id", F.col("text_sha256").alias("mark"), "kept"))
