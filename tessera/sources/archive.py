"""Archives of scanned pages: listings, which image belongs to which record, status by directory, and migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of image files, those tried for a record whose name tells no image, names in
# a record's own name, the formats and the two collections that folders are named after.
IMAGE = r"(?i)\.(jpg|jpeg|png|tif|tiff|bmp|gif)$"
TRIED = ("jpg", "jpeg", "png", "tif", "tiff", "JPG", "JPEG", "PNG")
NAMED = r"(?is)^(.+)_(jpg|jpeg|png|tif|tiff)"
FORMATS = ("JPG", "TIF", "TIFF", "PNG")
SCANS, MICROFILM = "Relief Record Scans", "Microfilm Digitization"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder that are not empty: ``path``, ``length``. Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.left(path, F.char_length(path) - F.char_length(file_name(path)) - 1)


def stem(path: Column) -> Column:
    """A file's name without its last extension; a dot at its start is none."""
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]+$", "")


def is_image(path: Column) -> Column:
    return file_name(path).rlike(IMAGE)


def is_record(path: Column) -> Column:
    return file_name(path).rlike(r"\.(json|txt)$")


def image_names(path: Column) -> Column:
    """The image names that a record's path stands for, best first: a name that is one already, one
    before an underscore and a format, or else the name with common extensions."""
    name = stem(path)
    whole = F.when(name.rlike(IMAGE), F.array(name)).otherwise(F.array().cast("array<string>"))
    base, kind = F.regexp_extract(name, NAMED, 1), F.regexp_extract(name, NAMED, 2)
    named = F.when(name.rlike(NAMED), F.array(*[F.concat(base, F.lit("."), k) for k in (kind, F.upper(kind), F.lower(kind))])).otherwise(F.array().cast("array<string>"))
    known = F.concat(whole, named)
    plain = F.replace(F.replace(name, F.lit(".json"), F.lit("")), F.lit(".txt"), F.lit(""))
    return F.when(F.size(known) > 0, known).otherwise(F.array(*[F.concat(plain, F.lit(f".{e}")) for e in TRIED]))


def paired_images(files: DataFrame) -> DataFrame:
    """Each record of a listing (``path``) with its image in the same folder: ``path, image``, null where there is none.

    Of several images that exist the first by :func:`image_names` counts.
    """
    records, images = files.where(is_record(F.col("path"))).select("path").distinct(), files.where(is_image(F.col("path"))).select(F.col("path").alias("image")).distinct()
    asked = records.select("path", F.posexplode(F.transform(image_names(F.col("path")), lambda n: F.concat(parent(F.col("path")), F.lit("/"), n))).alias("at", "image"))
    first = asked.join(images, "image").groupBy("path").agg(F.min_by("image", "at").alias("image"))
    return records.join(first, "path", "left")


def path_metadata(path: Column) -> Column:
    """Whom and what a path's folders name: person, collection, and the archive's own order."""
    parts = F.split(path, "/")
    person = F.get(F.filter(parts, lambda p: p.rlike(r"^\d+-.+$")), F.lit(0))
    collection = F.when(F.contains(path, F.lit(SCANS)), SCANS).when(F.contains(path, F.lit(MICROFILM)), MICROFILM)
    last = lambda test: F.element_at(F.filter(parts, test), -1)
    some = lambda test: F.when(F.exists(parts, test), last(test))
    scans = collection == SCANS
    return F.struct(
        person.alias("person_folder"), F.nullif(F.regexp_extract(person, r"^(\d+)-", 1), F.lit("")).alias("person_id"), F.nullif(F.regexp_extract(person, r"^\d+-(.+)$", 1), F.lit("")).alias("person_name"), collection.alias("collection"),
        F.when(scans, some(lambda p: p.isin(*FORMATS))).alias("format"), F.when(scans, some(lambda p: F.contains(p, F.lit("Box")))).alias("physical_box"),
        F.when(collection == MICROFILM, some(lambda p: F.contains(p, F.lit("Microfilm")))).alias("series"),
    )


def migrated(records: DataFrame, pairs: DataFrame, root: str) -> DataFrame:
    """Records (``path, content``) as they are to be stored: ``path, image, status, document, error``.

    ``status`` is ``copied``, ``mismatch`` (no image) or ``error`` (no JSON object). The document is
    the record's own with its relative path, person, collection, archive structure and where it came from.
    """
    base = root.rstrip("/") + "/"
    path = F.col("path")
    inside = F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
    folder = F.when(F.contains(inside, F.lit("/")), parent(inside)).otherwise("")
    name = F.when(stem(path).rlike(r"\.json$"), stem(path)).otherwise(F.concat(stem(path), F.lit(".json")))
    own = F.try_variant_get(F.try_parse_json("content"), "$", "map<string,variant>")
    about = path_metadata(path)
    structure = F.struct(about["format"].alias("format"), about["physical_box"].alias("physical_box"), about["series"].alias("series"), F.filter(F.split(folder, "/"), lambda p: p != "").alias("path_components"))
    given = F.struct(F.concat_ws("/", F.nullif(folder, F.lit("")), name).alias("relative_path"), *[about[c].alias(c) for c in ("person_folder", "person_id", "person_name", "collection")], structure.alias("archive_structure"))
    metadata = F.coalesce(F.try_variant_get(F.try_element_at("own", F.lit("metadata")), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = records.join(pairs, "path", "left").withColumns({"own": own, "given": F.from_json(F.to_json(given), "map<string,variant>")})
    origin = F.create_map(F.lit("migrated_from"), F.parse_json(F.to_json(F.struct(path.alias("x")))))
    rows = rows.withColumn("origin", F.transform_values(origin, lambda _, v: F.try_variant_get(v, "$.x", "variant")))
    whole = F.map_concat(F.map_filter("own", lambda k, _: ~F.map_contains_key("given", k) & (k != "metadata")), "given", F.create_map(F.lit("metadata"), F.to_variant_object(F.map_concat(F.map_filter(metadata, lambda k, _: k != "migrated_from"), "origin"))))
    status = F.when(F.col("image").isNull(), "mismatch").when(F.col("own").isNull(), "error").otherwise("copied")
    error = F.when(F.col("image").isNull(), F.concat(F.lit("No matching image found for "), file_name(path))).when(F.col("own").isNull(), F.concat(F.lit("Invalid JSON in "), path))
    return rows.select("path", "image", status.alias("status"), F.when(status == "copied", F.to_json(whole)).alias("document"), error.alias("error"))


def migration_counts(files: DataFrame, done: DataFrame) -> DataFrame:
    """Records and images found, copied, without a partner, and in error: one row."""
    found = files.agg(F.count_if(is_record(F.col("path"))).alias("json_found"), F.count_if(is_image(F.col("path"))).alias("images_found"))
    return found.crossJoin(done.agg(F.count_if(F.col("status") == "copied").alias("copied"), F.count_if(F.col("status") == "mismatch").alias("mismatches"), F.count_if(F.col("status") == "error").alias("errors")))


def directory_status(files: DataFrame, record: str = ".json", text: str = ".txt") -> DataFrame:
    """Per directory, and over all (null): images, how many are complete, have their text only, or
    need processing, and the share complete.

    An image is complete if a file of its name and ``record`` stands beside it; its text has ``text``.
    """
    images = files.where(is_image(F.col("path"))).select("path").distinct()
    names = files.select(F.col("path").alias("beside"), F.lit(True).alias("there")).distinct()
    for column, end in (("complete", record), ("text", text)):
        images = images.join(names.select("beside", F.col("there").alias(column)), F.concat(F.col("path"), F.lit(end)) == F.col("beside"), "left").drop("beside")
    rows = images.select(parent(F.col("path")).alias("directory"), F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("text", F.lit(False)).alias("text"))
    n = F.count(F.lit(1))
    return rows.rollup("directory").agg(n.alias("images"), F.count_if("complete").alias("complete"), F.count_if(~F.col("complete") & F.col("text")).alias("text_only"), F.count_if(~F.col("complete") & ~F.col("text")).alias("needs_processing"), (F.floor(F.try_divide(F.count_if("complete") * 100.0, n) * 100 + 0.5) / 100).alias("completion_rate"))


def extension_counts(files: DataFrame) -> DataFrame:
    """Images by extension in lower case."""
    return files.where(is_image(F.col("path"))).groupBy(F.lower(F.regexp_extract(file_name(F.col("path")), r"(\.[^.]+)$", 1)).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def short_tree(files: DataFrame, root: str, depth: int = 2, most: int = 5) -> DataFrame:
    """Each directory down to ``depth`` with its first ``most`` subdirectories and files by name: ``directory, dirs, files``.

    The root is ``.``. Names are ranked before they are gathered.
    """
    base = root.rstrip("/") + "/"
    inside = files.where(F.startswith("path", F.lit(base))).select(F.split(F.substring("path", len(base) + 1, 1 << 30), "/").alias("parts"))
    steps = inside.select("parts", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth + 1)))).alias("n"))
    here = F.when(F.col("n") == 1, ".").otherwise(F.array_join(F.slice("parts", 1, F.col("n") - 1), "/"))
    entries = steps.select(here.alias("directory"), F.element_at("parts", F.col("n")).alias("name"), (F.col("n") == F.size("parts")).alias("is_file")).distinct()
    ranked = entries.withColumn("nth", F.row_number().over(Window.partitionBy("directory", "is_file").orderBy("name"))).where(F.col("nth") <= most)
    names = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("name"))))
    return ranked.groupBy("directory").agg(names(~F.col("is_file")).alias("dirs"), names(F.col("is_file")).alias("files"))
