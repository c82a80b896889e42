"""Incremental ingestion of a growing folder: files once, contents once, failures as rows, counts for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.numbering import number_rows, running_sums
from tessera.sources.tables import clean_json

#: Names of the files that are taken, in any case.
PATTERN = "*.{[jJ][sS][oO][nN],[tT][xX][tT]}"
#: The reasons for which a file fails: fixed values.
NO_OBJECT = "Invalid JSON format: Unable to find valid JSON object."
NOT_VALID = "Invalid JSON format after cleaning."
NOT_TEXT = "The file is not valid UTF-8."

FILES = "file_path string, file_hash string, status string, error string"
DOCUMENTS = "file_path string, filename string, relative_path string, file_hash string, document string"


def parsed(files: DataFrame, root: str) -> DataFrame:
    """``files`` (``file_path, content``) with ``document``, the JSON object that was found, or ``error``.

    Control characters go, and what stands around the outermost braces. A text that is no JSON
    then is tried once more with its backslash escapes resolved. ``filename`` and
    ``relative_path`` are the document's own where it has them.
    """
    body = F.nullif(clean_json(F.col("content")), F.lit(""))
    fixed = _unescaped(body)
    first, second = F.try_parse_json(body), F.try_parse_json(fixed)
    rows = files.withColumns({"__body": body, "__first": first, "__second": F.when(first.isNull() & body.isNotNull(), second)})
    value = F.coalesce("__first", "__second")
    path = F.col("file_path")
    name = F.element_at(F.split(path, "/"), -1)
    inside = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)
    error = F.when(F.col("content").isNull(), NOT_TEXT).when(F.col("__body").isNull(), NO_OBJECT).when(value.isNull(), NOT_VALID)
    own = lambda field: F.try_variant_get(value, f"$.{field}", "string")
    return rows.select(
        "file_path", "file_hash", F.coalesce(own("filename"), name).alias("filename"), F.coalesce(own("relative_path"), inside).alias("relative_path"),
        F.when(value.isNotNull(), F.coalesce(F.when(F.col("__first").isNotNull(), F.col("__body")), fixed)).alias("document"), error.alias("error"),
    )


def _unescaped(text: Column) -> Column:
    """A text with its commonest backslash escapes resolved."""
    for mark, value in (('\\"', '"'), ("\\/", "/"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\'", "'"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(value))
    return text


def _stored(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """What earlier batches wrote to a table of batches; a batch that is run again does not see itself."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") != batch)


def ingest(spark: SparkSession, folder: str, out: str, files_per_batch: int = 10_000) -> None:
    """Take every file that ``folder`` has and that was not taken before, then stop.

    A file stream lists the folder and its subfolders; its checkpoint below ``out`` remembers the
    files, so a later run, or one after a crash, goes on where the last one stopped. Of files with
    equal contents, in this or any earlier run, the first by path is ``processed`` and the others
    are ``skipped``; a file without a valid JSON object has ``failed`` and may come again under
    another name. Each batch writes its own partition of the tables ``files`` (path, hash, status,
    error) and ``documents``, and writes it again, alike, if it is repeated.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def take(files: DataFrame, batch: int) -> None:
        session = files.sparkSession
        hashed = files.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"))
        known = _stored(session, f"{out}/files", FILES, batch).where("status = 'processed'").select("file_hash").distinct()
        rows = parsed(hashed, root).join(known.withColumn("known", F.lit(True)), "file_hash", "left")
        # The first valid file of a content is the one that is taken; a content is valid or not as a whole.
        first = rows.groupBy("file_hash").agg(F.min("file_path").alias("first"))
        rows = rows.join(first, "file_hash").withColumn("status", F.when(F.col("known").isNotNull() | (F.col("error").isNull() & (F.col("file_path") != F.col("first"))), "skipped").when(F.col("error").isNull(), "processed").otherwise("failed"))
        rows = rows.persist()
        try:
            rows.select("file_path", "file_hash", "status", F.when(F.col("status") == "failed", F.concat(F.lit("Error processing file "), "filename", F.lit(": "), "error")).alias("error")).write.mode("overwrite").parquet(f"{out}/files/batch={batch}")
            rows.where("status = 'processed'").select("file_path", "filename", "relative_path", "file_hash", "document").write.mode("overwrite").parquet(f"{out}/documents/batch={batch}")
        finally:
            rows.unpersist()

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ingested_documents(spark: SparkSession, out: str) -> DataFrame:
    return _stored(spark, f"{out}/documents", DOCUMENTS, -1)


def ingested_files(spark: SparkSession, out: str) -> DataFrame:
    return _stored(spark, f"{out}/files", FILES, -1)


def run_counts(files: DataFrame) -> DataFrame:
    """Per batch how many files were found, processed, skipped and failed."""
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    return files.groupBy("batch").agg(F.count(F.lit(1)).alias("found"), n("processed"), n("skipped"), n("failed"))


def progress_events(files: DataFrame) -> DataFrame:
    """One event for each file, in order of batch and path: its kind and the counts so far."""
    kinds = F.when(F.col("status") == "processed", "complete").when(F.col("status") == "skipped", "skip").otherwise("error")
    rows = files.select(F.lit(0).alias("run"), "batch", "file_path", kinds.alias("kind"), "status")
    sums = {name: (F.col("status") == status).cast("long") for name, status in (("processed", "processed"), ("skipped", "skipped"), ("errors", "failed"))}
    done = running_sums(rows, "run", ["batch", "file_path"], sums)
    return done.select("batch", "file_path", "kind", "processed", "skipped", "errors")


def events_since(events: DataFrame, since: int) -> DataFrame:
    """Events from number ``since`` on, numbered by ``batch`` and ``file_path``: what a reader with that cursor has not seen."""
    return number_rows(events, "batch", "file_path", name="cursor").where(F.col("cursor") >= max(0, since))


def combined_hash(files: DataFrame, fan: int = 1 << 16) -> DataFrame:
    """One SHA-256 over all file hashes in order of path: ``combined_hash``.

    Hashes are joined ``fan`` at a time, by number, and hashed level by level until one is left;
    up to ``fan`` files that is the hash of all hashes in a row. An empty folder gives the hash of nothing.
    """
    level = number_rows(files.select("file_path", "file_hash"), "file_path", "file_hash").select("no", F.col("file_hash").alias("hash"))
    n = level.count()
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "hash"))), lambda x: x["hash"]), "")
        n = -(-n // fan)
        if n <= 1:
            return level.agg(F.sha2(joined, 256).alias("combined_hash"))
        level = level.groupBy(F.floor(F.col("no") / fan).alias("no")).agg(F.sha2(joined, 256).alias("hash"))


def unchanged(files: DataFrame, stored: DataFrame | None) -> bool:
    """Whether the files are those of the stored ``combined_hash``, so that a load can be left out."""
    last = stored.select("combined_hash").first() if stored is not None else None
    return last is not None and last[0] == combined_hash(files).first()[0]
