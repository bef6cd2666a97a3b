"""Sources: typed event reads, pruned dimension reads, id lists, targets,
reuse-or-compute materialization, and sinks that write and read back keyed tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele import config as C
from clientele.operators import counts as K
from clientele.operators import joins as J
from clientele.session import scratch_dir, scratch_path

# Declared input schemas (FIXTURES.md section 1): product events, visits, searches.
PRODUCT_EVENT_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("sku", T.LongType())])
PAGE_VISIT_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("url", T.LongType())])
SEARCH_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("query", T.StringType())])
SCHEMA_OF = {C.PRODUCT_BUY: PRODUCT_EVENT_SCHEMA, C.ADD_TO_CART: PRODUCT_EVENT_SCHEMA,
             C.REMOVE_FROM_CART: PRODUCT_EVENT_SCHEMA, C.PAGE_VISIT: PAGE_VISIT_SCHEMA,
             C.SEARCH_QUERY: SEARCH_SCHEMA}


def read_events(spark: SparkSession, path: str, event_type: str) -> DataFrame:
    """Read one event table from parquet with its declared schema."""
    return spark.read.schema(SCHEMA_OF[event_type]).parquet(path)


def conform(df: DataFrame, event_type: str) -> DataFrame:
    """Cast a frame to the declared schema of its event type (timestamp → NTZ)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                       for f in SCHEMA_OF[event_type].fields])


def src_events(tables, event_type: str) -> DataFrame:
    return conform(tables.event_table(event_type), event_type)


def src_properties(tables, columns: list[str]) -> DataFrame:
    """Product dimension with a column subset (the scan reads only those columns)."""
    return tables.product_properties.select(*columns)


def src_id_lists(ctx) -> DataFrame:
    """Relevant / active clients, propensity targets and item popularity in long form."""
    null = F.lit(None).cast("long")
    return (ctx.relevant_clients.select(F.lit("relevant").alias("list_name"),
                                        F.col("client_id").alias("id"), null.alias("value"))
            .unionByName(ctx.active_clients.select(F.lit("active").alias("list_name"),
                                                   F.col("client_id").alias("id"), null.alias("value")))
            .unionByName(ctx.propensity_sku.select(F.lit("propensity_sku").alias("list_name"),
                                                   F.col("item").alias("id"),
                                                   F.col("pos").cast("long").alias("value")))
            .unionByName(ctx.propensity_category.select(
                F.lit("propensity_category").alias("list_name"), F.col("item").alias("id"),
                F.col("pos").cast("long").alias("value")))
            .unionByName(K.item_popularity(ctx.input_buys).select(
                F.lit("popularity_sku").alias("list_name"), F.col("item").alias("id"),
                F.col("popularity").alias("value"))))


def src_targets(ctx) -> DataFrame:
    t, v = ctx.targets()
    return (t.withColumn("target", F.lit("train_target"))
            .unionByName(v.withColumn("target", F.lit("validation_target"))))


def load_with_properties(tables, event_type: str, check: bool = False) -> DataFrame:
    """Read a type; join properties unless it is a page visit or a search."""
    df = src_events(tables, event_type)
    if event_type in (C.PAGE_VISIT, C.SEARCH_QUERY):
        return df
    if check:
        return J.join_properties_checked(df, tables.product_properties)
    return df.join(tables.product_properties, "sku", "left")


def path_key(s: str) -> str:
    return hashlib.sha1(s.encode()).hexdigest()[:10]


def _fs(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, files: list[str]) -> str:
    """A digest of the names, sizes and times of files (folders are listed once each)."""
    known, wanted = {}, sorted(files)
    for folder in sorted({f.rsplit("/", 1)[0] for f in wanted}):
        jpath, fs = _fs(spark, folder)
        for st in fs.listStatus(jpath):
            known[st.getPath().getName(), folder] = (st.getLen(), st.getModificationTime())
    marks = [(f, *known.get((unquote(f.rsplit("/", 1)[1]), f.rsplit("/", 1)[0]), (-1, -1))) for f in wanted]
    return hashlib.sha1(repr(marks).encode()).hexdigest()


def _read_small(spark: SparkSession, path: str) -> str | None:
    jpath, fs = _fs(spark, path)
    if not fs.exists(jpath):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place by a rename that fails if the file is there already."""
    jvm = spark.sparkContext._jvm
    temp, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temp, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(rename, 1)
    none[0] = rename.NONE
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, target, none)
        return True
    except Py4JJavaError as e:
        if not fs.exists(target):
            raise
        fs.delete(temp, False)
        del e
        return False


def materialize_once(spark: SparkSession, name: str, compute: Callable[[], DataFrame] | None,
                     inputs: list[str] | None = None) -> DataFrame:
    """Reuse a table written earlier under the shared scratch folder, else compute and
    write it. With ``compute=None`` the table published last; a missing one is an error
    (required upstream).

    A table is written to a folder of its own and becomes visible by a manifest, which is
    named after the fingerprint of the inputs (by default the files that the plan of
    ``compute`` reads: names, sizes, times) and published by one rename. So a changed input
    is computed again, a broken write is never read, and of two writers at once the first
    manifest stands: the other reads that table and removes its own.
    """
    base = f"{scratch_dir(spark).rstrip('/')}/materialized/{name}"
    if compute is None:
        latest = _latest_manifest(spark, base)
        if latest is None:
            raise FileNotFoundError(f"{name} not found under {base}: run the step that produces it first")
        return spark.read.parquet(_read_small(spark, latest))
    df = compute()
    manifest = f"{base}/manifest-{fingerprint(spark, inputs if inputs is not None else df.inputFiles())}"
    path = _read_small(spark, manifest)
    if path is None:
        path = f"{base}/data-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not _publish(spark, manifest, path):
            own, fs = _fs(spark, path)
            fs.delete(own, True)
            path = _read_small(spark, manifest)
    return spark.read.parquet(path)


def _latest_manifest(spark: SparkSession, base: str) -> str | None:
    jpath, fs = _fs(spark, base)
    if not fs.exists(jpath):
        return None
    found = [(st.getModificationTime(), st.getPath().toString()) for st in fs.listStatus(jpath)
             if st.getPath().getName().startswith("manifest-") and not st.getPath().getName().endswith(".tmp")]
    return max(found)[1] if found else None


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None) -> str:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df
    if sort_within:
        # the writer sorts by the partition columns itself unless the rows have that order already
        w = w.sortWithinPartitions(*(partition_by or []), *sort_within)
    writer = w.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def sink_features(df: DataFrame, name: str) -> DataFrame:
    """Write event features as parquet; returns the table read back."""
    path = write_table(df, name)
    return df.sparkSession.read.parquet(path)


def write_sequences(long_seq: DataFrame, name: str, n_parts: int | None = None) -> str:
    """Write ``client_id, pos, ...`` in (client, position) order, split by ranges of both, so
    a client with most of the rows is spread over many files; returns the folder.

    Each range is a folder ``part=<number>`` of ``data`` (numbers follow the order) whose rows
    are sorted; ``manifest`` tells the first and last (client, position) and the rows of each
    part. Without ``n_parts`` the sizes decide the number of parts.
    """
    path = scratch_path(long_seq.sparkSession, name)
    keys = ["client_id", "pos"]
    ranged = long_seq.repartitionByRange(n_parts, *keys) if n_parts else long_seq.repartitionByRange(*keys)
    ranged = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *keys)
    ranged.write.partitionBy("part").parquet(f"{path}/data")
    at = F.struct(*keys)
    back = long_seq.sparkSession.read.parquet(f"{path}/data")
    (back.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))
     .orderBy("part").coalesce(1).write.parquet(f"{path}/manifest"))
    return path


def sequence_parts(spark: SparkSession, path: str, client_id: int) -> list[int]:
    """The numbers of the parts that hold a client, in the order of its positions."""
    m = spark.read.parquet(f"{path}/manifest")
    hit = m.where((F.col("first.client_id") <= client_id) & (F.col("last.client_id") >= client_id))
    return [r["part"] for r in hit.orderBy("part").collect()]


def read_sequence(spark: SparkSession, path: str, client_id: int) -> DataFrame:
    """One client's events in order: only its parts are read."""
    parts = sequence_parts(spark, path, client_id)
    return (spark.read.parquet(f"{path}/data").where(F.col("part").isin(parts) & (F.col("client_id") == client_id))
            .orderBy("part", "pos").drop("part"))


def sink_sequences(long_seq: DataFrame, relevant: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Write all-client and relevant-client sequence tables (long form, one row per event)
    by :func:`write_sequences`. Returns the relevant table read back."""
    write_sequences(long_seq, "grouped_all", n_parts)
    rel = long_seq.join(relevant.select("client_id").distinct(), "client_id", "left_semi")
    return long_seq.sparkSession.read.parquet(f"{write_sequences(rel, 'grouped_relevant', n_parts)}/data")


def sink_embeddings(emb: DataFrame, name: str = "embeddings") -> DataFrame:
    """One keyed table ``client_id, embedding`` sorted by client id."""
    path = write_table(emb.select("client_id", "embedding").orderBy("client_id"), name)
    return emb.sparkSession.read.parquet(path)


def sink_split(ctx) -> DataFrame:
    """Write the input chunk of each type and the two target tables; returns a summary
    ``output, rows`` read back from the written files."""
    spark = ctx.spark
    tr, va, end = ctx.split
    outs = []
    for t in [C.PRODUCT_BUY, C.ADD_TO_CART, C.REMOVE_FROM_CART, C.PAGE_VISIT, C.SEARCH_QUERY]:
        df = ctx.event_table(t).where(F.col("timestamp") < F.lit(tr))
        outs.append((f"input/{t}", write_table(df, f"input_{t}")))
    tt, vt = ctx.targets()
    outs.append(("target/train_target", write_table(tt, "train_target")))
    outs.append(("target/validation_target", write_table(vt, "validation_target")))
    res = None
    for name, path in outs:
        r = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("output"), "rows")
        res = r if res is None else res.unionByName(r)
    return res


def sink_scores(best: DataFrame) -> DataFrame:
    """Best score and best epoch per task as JSON lines; returns the JSON read back."""
    path = scratch_path(best.sparkSession, "scores")
    best.coalesce(1).write.mode("overwrite").json(path)
    return best.sparkSession.read.schema(best.schema).json(path)
