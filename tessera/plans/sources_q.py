"""Sources and sinks as round trips through a folder below spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.registry import register
from tessera.session import scratch_path
from tessera.sources import files as FS
from tessera.sources.tables import read, table_path


def t(spark, sf_dir, name):
    return read(spark, sf_dir, name)


@register("src_parquet", """
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       o_orderstatus FROM orders""")
def q_src_parquet(spark, sf_dir):
    """Two writes with different columns into one partitioned folder, read
    back with partition discovery and merged schemas."""
    base = scratch_path(spark, "parquet-merge")
    o = t(spark, sf_dir, "orders")
    FS.write(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus"),
             base, "parquet", "append", "o_orderstatus")
    FS.write(o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"),
             base, "parquet", "append", "o_orderstatus")
    back = spark.read.option("mergeSchema", True).parquet(base)
    return back.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@register("src_json", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_src_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    FS.write(t(spark, sf_dir, "events"), path, "json", timestampNTZFormat=fmt)
    return FS.read(spark, path, "json", schema=EVENTS_SCHEMA, timestampNTZFormat=fmt)


@register("src_json_inferred", "SELECT event_id, event_type, value FROM events")
def q_src_json_inferred(spark, sf_dir):
    path = scratch_path(spark, "json-infer")
    FS.write(t(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, "json")
    return spark.read.option("primitivesAsString", False).json(path).select("event_id", "event_type", "value")


@register("src_csv", """SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def q_src_csv(spark, sf_dir):
    """';'-separated CSV with a header and quoted fields, plus a malformed file
    derived from the same rows; DROPMALFORMED keeps only well-formed rows."""
    base = scratch_path(spark, "csv")
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    FS.write(c, f"{base}/good", "csv", header=True, sep=";", quote='"', quoteAll=True)
    bad = c.select(F.concat_ws(";", F.lit("not-a-number"), "c_name").alias("value"))
    bad.write.mode("overwrite").text(f"{base}/bad")
    schema = "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING"
    return spark.read.schema(schema).option("header", True).option("sep", ";").option("mode", "DROPMALFORMED") \
        .option("recursiveFileLookup", True).csv(base)


@register("src_text", "SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def q_src_text(spark, sf_dir):
    """Whole texts written as text, read back one row per line."""
    path = scratch_path(spark, "text")
    t(spark, sf_dir, "documents").select(F.col("text").alias("value")).write.mode("overwrite").text(path)
    return spark.read.option("lineSep", "\n").text(path)


@register("src_text_wholetext", "SELECT count(*) AS n_docs, sum(length(text) + 1) AS n_chars FROM documents")
def q_src_text_wholetext(spark, sf_dir):
    """The same folder read with wholetext: one row per file; characters add up."""
    path = scratch_path(spark, "wholetext")
    t(spark, sf_dir, "documents").select(F.col("text").alias("value")).write.mode("overwrite").text(path)
    whole = spark.read.text(path, wholetext=True)
    n_docs = t(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    return whole.agg(F.sum(F.length("value")).alias("n_chars")).withColumn("n_docs", n_docs) \
        .select("n_docs", "n_chars")


@register("src_orc", "SELECT * FROM orders")
def q_src_orc(spark, sf_dir):
    path = scratch_path(spark, "orc")
    FS.write(t(spark, sf_dir, "orders"), path, "orc")
    return spark.read.orc(path)


@register("src_options", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem""")
def q_src_options(spark, sf_dir):
    """Nested folders, a junk file, and reader options: recursive lookup, a
    name glob, a modification-time bound and skipping corrupt files."""
    base = scratch_path(spark, "options")
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    FS.write(li.where("l_returnflag = 'A'").drop("l_returnflag"), f"{base}/a", "parquet")
    FS.write(li.where("l_returnflag <> 'A'").drop("l_returnflag"), f"{base}/b/c", "parquet")
    li.select(F.lit("junk").alias("value")).limit(1).write.mode("overwrite").text(f"{base}/junk")
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet") \
        .option("modifiedAfter", "2000-01-01T00:00:00").option("ignoreCorruptFiles", True).parquet(base)


@register("src_sql_on_files", """
SELECT n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_src_sql_on_files(spark, sf_dir):
    return spark.sql(f"""SELECT n_name, count(*) AS n_customers
        FROM parquet.`{table_path(sf_dir, 'customer')}` c JOIN parquet.`{table_path(sf_dir, 'nation')}` n
        ON c.c_nationkey = n.n_nationkey GROUP BY n_name""")


@register("src_range", """
SELECT id FROM (SELECT unnest(generate_series((SELECT min(o_orderkey) FROM orders), (SELECT max(o_orderkey) FROM orders))) AS id)
WHERE id NOT IN (SELECT o_orderkey FROM orders)""")
def q_src_range(spark, sf_dir):
    """Generated ids over the key range of orders, minus the keys in use."""
    o = t(spark, sf_dir, "orders")
    lo, hi = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    ids = spark.range(lo, hi + 1, 1, numPartitions=spark.sparkContext.defaultParallelism)
    return ids.join(o, ids.id == o.o_orderkey, "left_anti")


@register("src_local_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_src_local_rows(spark, sf_dir):
    """Rows rebuilt from Python objects with inferred and with given schemas.
    nation is a fixed 25-row dimension, so the driver holds a bounded list."""
    rows = t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    inferred = spark.createDataFrame([r.asDict() for r in rows])
    given = spark.createDataFrame([tuple(r) for r in rows],
                                  "n_nationkey INT, n_name STRING, n_regionkey INT", verifySchema=True)
    return inferred.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int")) \
        .intersect(given)


@register("src_table_view", """
SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1""")
def q_src_table_view(spark, sf_dir):
    name = f"cust_{uuid.uuid4().hex[:8]}"
    t(spark, sf_dir, "customer").createOrReplaceTempView(name)
    t(spark, sf_dir, "customer").createOrReplaceGlobalTempView(name)
    local = spark.table(name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    glob = spark.table(f"global_temp.{name}").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n2"))
    return local.join(glob, "c_mktsegment").where("n = n2").select("c_mktsegment", "n")


@register("sink_files", """
SELECT c_custkey, c_name, 'parquet' AS fmt FROM customer UNION ALL SELECT c_custkey, c_name, 'parquet' FROM customer
UNION ALL SELECT c_custkey, c_name, 'json' FROM customer UNION ALL SELECT c_custkey, c_name, 'csv' FROM customer""")
def q_sink_files(spark, sf_dir):
    """overwrite, append, ignore and error modes in parquet, json and csv."""
    base = scratch_path(spark, "sink")
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    FS.write(c, f"{base}/p", "parquet", "overwrite")
    FS.write(c, f"{base}/p", "parquet", "append")
    FS.write(c.limit(0), f"{base}/p", "parquet", "ignore")  # exists: no-op
    try:
        FS.write(c, f"{base}/p", "parquet", "error")
        raise AssertionError("mode error wrote into an existing folder")
    except Exception as exc:  # noqa: BLE001
        if isinstance(exc, AssertionError):
            raise
    FS.write(c, f"{base}/j", "json", "overwrite")
    FS.write(c, f"{base}/c", "csv", "overwrite", header=True)
    p = spark.read.parquet(f"{base}/p").withColumn("fmt", F.lit("parquet"))
    j = spark.read.schema("c_custkey BIGINT, c_name STRING").json(f"{base}/j").withColumn("fmt", F.lit("json"))
    cs = spark.read.schema("c_custkey BIGINT, c_name STRING").option("header", True).csv(f"{base}/c") \
        .withColumn("fmt", F.lit("csv"))
    return p.unionByName(j).unionByName(cs)


@register("sink_partition_bucket", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def q_sink_partition_bucket(spark, sf_dir):
    """Partitioned, bucketed and sorted external table, read through the catalog."""
    name = f"orders_b_{uuid.uuid4().hex[:8]}"
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    FS.save_table(o, name, scratch_path(spark, "bucketed"), partition_by=["o_orderstatus"],
                  bucket_by=(8, ["o_custkey"]), sort_by=["o_custkey"])
    return spark.table(name).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@register("sink_insert_into", """
SELECT r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT n_nationkey, n_name FROM nation""")
def q_sink_insert_into(spark, sf_dir):
    """insertInto matches columns by position, not by name."""
    name = f"kv_{uuid.uuid4().hex[:8]}"
    r = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    FS.save_table(r, name, scratch_path(spark, "insert"))
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("names"))
    n.write.insertInto(name)
    return spark.table(name)


@register("sink_v2", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def q_sink_v2(spark, sf_dir):
    """DataFrameWriterV2 create, with a plain partition column, on the session
    catalog. Its append/overwrite/replace forms and partition transforms need
    a v2 catalog (Iceberg, Delta) that this environment does not ship."""
    name = f"v2_{uuid.uuid4().hex[:8]}"
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    o.writeTo(name).using("parquet").option("path", scratch_path(spark, "v2")) \
        .partitionedBy(F.col("o_orderstatus")).create()
    return spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
