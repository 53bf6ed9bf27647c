"""Queries that write tables in the formats of the engine and read them back, and rules over annotation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, order
from ..sources import readers, shared, writers
from ..streaming import log
from .registry import registry, table

QUERIES, SQL, query = registry()


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def streamed_latest(spark, sf_dir):
    """The log as a stream of four files, a micro-batch each: latest rows from keyed state, folded at the end."""
    folder = shared.scratch(spark, "latest")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    keys, rank = ["user_id"], ["ts", "event_id"]
    log.stream_latest(stream, f"{folder}/changes", keys, rank, f"{folder}/state").awaitTermination()
    log.fold_changes(spark, f"{folder}/changes", keys, rank)
    return log.latest_view(spark, f"{folder}/changes", keys, rank).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS characters, md5(text) AS digest FROM documents")
def read_json_lines(spark, sf_dir):
    folder = shared.scratch(spark, "lines")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.json(f"{folder}/documents.jsonl")
    back = readers.load_table(spark, f"{folder}/documents.jsonl", "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.length("text").alias("characters"), F.md5("text").alias("digest"))


@query("SELECT p_partkey, p_name FROM part")
def read_tsv_columns(spark, sf_dir):
    """Two columns of a lexicon in tab-separated text."""
    folder = shared.scratch(spark, "lexicon")
    table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_type", "p_name").write.option("header", True).option("sep", "\t").csv(f"{folder}/part.tsv")
    return readers.load_columns(spark, f"{folder}/part.tsv", ["p_partkey", "p_name"], "p_brand string, p_partkey long, p_type string, p_name string")


@query("SELECT DISTINCT lower(trim(p_type)) AS word FROM part WHERE trim(p_type) <> ''")
def read_word_list(spark, sf_dir):
    folder = shared.scratch(spark, "words")
    table(spark, sf_dir, "part").select("p_type", "p_size").write.option("header", True).csv(f"{folder}/words.csv")
    return readers.load_word_list(spark, f"{folder}/words.csv", "p_type")


@query(r"""
WITH l AS (SELECT trim(unnest(string_split_regex(text, '\r\n|\r|\n'))) AS value FROM documents)
SELECT md5(value) AS line, count(*) AS rows FROM l WHERE value <> '' GROUP BY 1""")
def read_lines(spark, sf_dir):
    """Lines of plain text files, blank ones left out."""
    folder = shared.scratch(spark, "text")
    table(spark, sf_dir, "documents").select("text").write.text(f"{folder}/documents.txt")
    return readers.load_lines(spark, f"{folder}/documents.txt").groupBy(F.md5("value").alias("line")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT doc_id AS index, CASE WHEN doc_id % 1000 >= 500 THEN toxic = 1 ELSE quality = 1 END AS label FROM labels")
def label_checkpoints(spark, sf_dir):
    """Labelling batches of a thousand ids as JSON maps; a later batch labels half of them again, and the later one counts."""
    folder = shared.scratch(spark, "batches")
    rows = table(spark, sf_dir, "labels").withColumn("b", F.floor(F.col("doc_id") / 1000))
    again = rows.filter("doc_id % 1000 >= 500").select((F.col("b") + 1).alias("b"), "doc_id", (F.col("toxic") == 1).alias("label"))
    batches = rows.select("b", "doc_id", (F.col("quality") == 1).alias("label")).unionByName(again).groupBy("b").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), "label")))).alias("value"))
    # zero-padded names, as the last file by name wins
    batches.select(F.concat(F.lit("b"), F.lpad(F.col("b").cast("string"), 12, "0")).alias("batch"), "value").write.mode("append").partitionBy("batch").text(folder)
    return readers.checkpoint_labels(spark, f"{folder}/batch=*")


@query("SELECT doc_id, toxic FROM labels WHERE quality = 1")
def replaced_table(spark, sf_dir):
    """A table written, replaced, and mended after a crash between the two renames."""
    path = f"{shared.scratch(spark, 'table')}/labels"
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    writers.replace_table(rows.select("doc_id", "toxic"), path)
    writers.replace_table(rows.filter("quality = 1").select("doc_id", "toxic"), path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(hadoop(path), hadoop(f"{path}.new"))
    writers.recover_table(spark, path)
    return readers.load_optional(spark, path + "/*.parquet", "doc_id long, toxic int")


_LATEST = "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query(f"SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN user_id % 3 = 0 THEN 'reviewed ' || event_type ELSE event_type END AS value FROM ({_LATEST})")
def appended_reviews(spark, sf_dir):
    """Reviewed values appended to a log whose rows are still those that were reviewed; the latest view of it."""
    path = f"{shared.scratch(spark, 'log')}/reviews"
    events = order.keep_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], keep=["user_id", "event_type"])
    writers.append_log(events.select("user_id", F.lit(1).alias("version"), F.col("event_type").alias("value")), path)
    held = spark.read.parquet(path)
    changes = held.filter("user_id % 3 = 0").select("user_id", F.col("value").alias("expected"), F.concat(F.lit("reviewed "), "value").alias("value"))
    writers.append_log(annotation.apply_if_unchanged(held.withColumnRenamed("value", "v"), changes, "user_id", "version", "v").withColumnRenamed("v", "value"), path)
    return order.keep_last(spark.read.parquet(path), ["user_id"], ["version"])


@query("""
WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_brand FROM part)
SELECT p_partkey, a || ' ' || p_brand AS reconstructed FROM w WHERE p_partkey % 6 = 0 AND b <> p_brand""")
def stale_annotations(spark, sf_dir):
    """Sentences that still say what was suggested although a token was corrected."""
    w = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", w[0].alias("a"), w[1].alias("b"), "p_brand").withColumn("auto", F.concat_ws(" ", "a", "b"))
    corrected = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
    tokens = F.array(F.struct(F.col("a").alias("token"), F.lit(None).cast("string").alias("final_correction")), F.struct(F.col("b").alias("token"), corrected.alias("final_correction")))
    seen = rows.withColumns({"payload": F.to_json(tokens), "manual": F.when(F.col("p_partkey") % 2 == 0, F.col("auto")).otherwise(F.concat("auto", F.lit("!")))})
    return annotation.stale_rows(seen, "auto", "manual", "payload").select("p_partkey", "reconstructed")


@query("""
SELECT o_orderkey AS occurrence_id, CASE WHEN o_orderkey % 5 = 0 THEN 'orphan_occurrence_id' ELSE 'token_pair_changed' END AS issue
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""")
def drifted_annotations(spark, sf_dir):
    """Annotations whose occurrence is gone from the gold rows, or says another pair now."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("occurrence_id"), F.col("o_orderstatus").alias("informal_token"), F.col("o_orderpriority").alias("formal_token"))
    gold = annotation.set_columns_where(rows.filter("occurrence_id % 5 <> 0"), F.col("occurrence_id") % 7 == 0, {"formal_token": F.lit("other"), "informal_token": F.lit("x")})
    return annotation.invalid_annotations(rows, gold).select("occurrence_id", "issue")


@query("""
WITH k AS (SELECT lower(split_part(p_name, ' ', 1)) AS key FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 10)
SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 AND lower(split_part(p_name, ' ', 1)) IN (SELECT key FROM k)""")
def ambiguous_identities(spark, sf_dir):
    """Automatic identity rows of words that have more than ten brands by now."""
    part = table(spark, sf_dir, "part").withColumn("formal_token", F.split("p_name", " ")[0])
    notes = F.when(F.col("p_partkey") % 2 == 0, F.lit("AUTO_IDENTITY_SEED")).otherwise(F.lit("by hand"))
    ambiguous = part.groupBy(F.lower("formal_token").alias("key")).agg(F.count_distinct("p_brand").alias("n")).filter("n > 10")
    return annotation.ambiguous_identity(part.withColumn("notes", notes), ambiguous).select("p_partkey", "p_name")
