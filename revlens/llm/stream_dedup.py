"""Exact deduplication as a stream whose keyed state lives on disk and never expires.

Documents arrive as files of a folder, in micro-batches. State is kept by the digest of the
text's bytes, in RocksDB with checkpoints in the shared folder: for each digest the stable
identifier (the greatest document id so far), the content locator of that document (its file
and row in it) and the number of documents. It is a streaming aggregation, so rows of equal
digest are combined in each task before they are shuffled, and a text that makes up a third of
all rows is one row a task. A later run over the same state takes up new files only, and a lost
executor's state is loaded from the last checkpoint.

*On a hit* full bytes decide. A digest that a new document shares with another one has the bytes
of its new documents compared with one another and with those at the locators that the state has
held for it: least and greatest bytes, combined in each task, must be the same. Documents of
digests that stand for different texts are settled by grouping them by whole texts. With SHA-256
none is known; tests use a digest of a few bits.

Defined results: null texts are empty texts. The row with the greatest id stays, a null id being
less than any other; of rows equal in id and text the last by file and row stays. Ids are whole
numbers or strings. Texts of any length stay where they are and travel for the comparison of
bytes alone. An empty folder has no classes. Further columns are ignored; a stream cannot take
back files that it has read, so files must not be changed or deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.tables import stored
from revlens.session import shared_dir

BATCHES = 4  # micro-batches that the files of a first run are dealt into

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Without it every partition's store takes 4 MB of disk in advance for its list of files.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _rows(docs: DataFrame, id_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, has and id (a null id is has = false), file, row and content of each document."""
    kind = docs.schema[id_column].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)):
        raise TypeError(f"{id_column}: ids are whole numbers or strings, not {kind.simpleString()}")
    none = F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(digest(text).alias("digest"), F.col(id_column).isNotNull().alias("has"),
                       F.coalesce(F.col(id_column), none).alias("id"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("row"), text.alias("content"))


def _stream(session: SparkSession, path: str, table: DataFrame, batches: int) -> DataFrame:
    """The files of a folder, or one file, as a stream of micro-batches."""
    found = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
    per_batch = max(-(-len(table.inputFiles()) // batches), 1)
    reader = (session.readStream.schema(table.schema).option("maxFilesPerTrigger", per_batch)
              .option("maxFileAge", "36500d"))
    if fs.getFileStatus(found).isFile():  # a stream reads folders: the one file's folder, without the others
        return reader.option("pathGlobFilter", found.getName()).parquet(found.getParent().toString())
    return reader.parquet(path)


def update_classes(spark: SparkSession, path: str, folder: str, id_column: str = "doc_id", batches: int = BATCHES,
                   digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Takes files of Parquet folder ``path`` that are new to the state in ``folder`` into it.

    Returns the classes: digest, has, id, file, row (of the document that stays), size; and ``differ``
    for digests that stand for different texts.
    """
    session = spark.newSession()  # its settings are its own, so that jobs beside this one keep theirs
    for key, value in {**STATE_CONF, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                       "spark.sql.session.timeZone": "UTC"}.items():
        session.conf.set(key, value)
    table = spark.read.parquet(path)
    files = table.inputFiles()
    rows = _rows(_stream(session, path, table, batches), id_column, digest)
    # The greatest struct: by id, then by place.
    state = rows.groupBy("digest").agg(F.max(F.struct("has", "id", "file", "row")).alias("top"), F.count("*").alias("size"))

    def write(batch: DataFrame, number: int) -> None:  # a repeated batch writes the same folder again
        batch.select("digest", "top.*", "size").write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    query = (state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    kind = table.schema[id_column].dataType.simpleString()
    schema = f"digest binary, has boolean, id {kind}, file string, row long, size long, batch long"
    updates = _read(spark, f"{folder}/updates", schema)
    last = stored(updates.groupBy("digest").agg(F.max_by(F.struct("has", "id", "file", "row", "size"), "batch").alias("c"))
                  .select("digest", "c.*"))
    checked = _read(spark, f"{folder}/checked", "file string, digest binary")
    differ = stored(_differing(table, last, updates, checked, id_column, digest))
    known = {r.file for r in checked.where("file is not null").collect()}  # names of input files, which Spark lists anyway
    done = spark.createDataFrame([(f, None) for f in files if f not in known], "file string, digest binary")
    differ.select(F.lit(None).cast("string").alias("file"), "digest").union(done).coalesce(1).write.mode("append").parquet(
        f"{folder}/checked")
    differ = differ.union(checked.where("digest is not null").select("digest")).distinct().withColumn("differ", F.lit(True))
    return stored(last.join(differ, "digest", "left").withColumn("differ", F.coalesce("differ", F.lit(False))))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the state's folder, empty before the first run."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _differing(table: DataFrame, classes: DataFrame, updates: DataFrame, checked: DataFrame, id_column: str,
               digest: Callable[[Column], Column]) -> DataFrame:
    """Digests whose documents differ in bytes, found by those of files that have not been checked yet."""
    hits = classes.where("size > 1").select("digest")
    known = [r.file for r in checked.where("file is not null").select("file").distinct().collect()]
    path = F.col("_metadata.file_path")
    new = _rows(table.where(~path.isin(known)) if known else table, id_column, digest).select("digest", "content")
    contents = new.join(hits, "digest", "left_semi")
    if known:
        # What the state has held for these digests before; its files alone are read again.
        touched = stored(contents.select("digest").distinct())
        held = stored(updates.join(touched, "digest", "left_semi").where(F.col("file").isin(known)).select("file", "row").distinct())
        files = [r.file for r in held.select("file").distinct().collect()]
        old = _rows(table.where(path.isin(files)), id_column, digest).join(held, ["file", "row"], "left_semi")
        contents = contents.union(old.select("digest", "content"))
    # Stored, so that the join above can be split for a digest of many rows, which are then combined in each task.
    contents = stored(contents)
    return (contents.groupBy("digest").agg(F.min("content").alias("least"), F.max("content").alias("most"))
            .where("least <> most").select("digest"))


def decisions(spark: SparkSession, path: str, folder: str | None = None, id_column: str = "doc_id", **parameters) -> DataFrame:
    """Each document with file, row, the id of the document that stays for it, the class's size and ``kept``."""
    digest = parameters.get("digest", sha256)
    classes = update_classes(spark, path, folder or shared_dir(spark), id_column, **parameters)
    table = spark.read.parquet(path)
    rows = _rows(table, id_column, digest).select(
        "digest", F.col("has").alias("own_has"), F.col("id").alias("own_id"), F.col("file").alias("own_file"),
        F.col("row").alias("own_row"), F.sha2("content", 256).alias("text_sha256"))
    # Both sides are plain shuffles (classes are stored), so that a digest of many rows can be split.
    settled = rows.join(classes.where("not differ").drop("differ"), "digest")
    mixed = classes.where("differ").select("digest")
    if not mixed.isEmpty():
        settled = settled.unionByName(_by_whole_text(table, mixed, id_column, digest))
    return settled.select(
        F.when(F.col("own_has"), F.col("own_id")).alias(id_column), F.col("own_file").alias("file"),
        F.col("own_row").alias("row"), F.when(F.col("has"), F.col("id")).alias("keep_id"), F.col("size").alias("group_size"),
        ((F.col("file") == F.col("own_file")) & (F.col("row") == F.col("own_row"))).alias("kept"), "text_sha256")


def _by_whole_text(table: DataFrame, mixed: DataFrame, id_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The documents of some digests, in classes by their bytes."""
    rows = stored(_rows(table, id_column, digest).join(mixed, "digest", "left_semi"))
    groups = stored(rows.groupBy("content").agg(F.max(F.struct("has", "id", "file", "row")).alias("top"),
                                                F.count("*").alias("size")))
    own = rows.select("digest", F.col("has").alias("own_has"), F.col("id").alias("own_id"), F.col("file").alias("own_file"),
                      F.col("row").alias("own_row"), F.sha2("content", 256).alias("text_sha256"), "content")
    return own.join(groups.select("content", "top.*", "size"), "content").drop("content")
