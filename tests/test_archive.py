import json
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from tessera.sources import archive

EXTENSIONS = "jpg|jpeg|png|tif|tiff|bmp|gif"


def image_for(path, there):
    name = path.stem
    names = [name] if re.search(rf"\.({EXTENSIONS})$", name, re.I) else []
    found = re.match(r"(.+)_(jpg|jpeg|png|tif|tiff)", name, re.I)
    if found:
        names += [f"{found[1]}.{e}" for e in (found[2], found[2].upper(), found[2].lower())]
    if not names:
        base = name.replace(".json", "").replace(".txt", "")
        names = [f"{base}.{e}" for e in archive.TRIED]
    return next((str(path.parent / n) for n in names if str(path.parent / n) in there), None)


def listing(spark, paths):
    return spark.createDataFrame([(p, 1) for p in paths], "path string, length long")


def test_images_of_records(spark):
    rng = random.Random(4)
    bases = ["RDApp-1", "roll_1-2", "page_001", "a.json", "x_jpg_y", ".hidden", "b_TIFF", "c.txt"]
    ends = [".jpg", ".JPG", ".jpeg", ".png", ".tif", ".TIFF", ".json", ".txt", "_jpg.txt", ".jpg.txt", ".png.json", "_tiff.json", ".gif.json", ".pdf", "_JPG.json"]
    paths = sorted({f"/r/{rng.choice(['d', 'e f'])}/{rng.choice(bases)}{rng.choice(ends)}" for _ in range(160)})
    got = {r.path: r.image for r in archive.paired_images(listing(spark, paths + paths[:5])).collect()}
    assert got == {p: image_for(Path(p), set(paths)) for p in paths if p.endswith((".json", ".txt"))}
    assert any(got.values()) and not all(got.values())
    assert archive.paired_images(listing(spark, [])).count() == 0


def test_metadata_of_paths(spark):
    rows = [
        ("/a/Relief Record Scans/JPG/Box 12/205406-Porter/x.json", ("205406-Porter", "205406", "Porter", "Relief Record Scans", "JPG", "Box 12", None)),
        ("/a/Microfilm Digitization/Microfilm 3/r.json", (None, None, None, "Microfilm Digitization", None, None, "Microfilm 3")),
        ("/a/1-b/2-c/x-1/y.json", ("1-b", "1", "b", None, None, None, None)),
    ]
    got = listing(spark, [r[0] for r in rows]).select("path", archive.path_metadata(F.col("path")).alias("m")).collect()
    assert {r.path: tuple(r.m) for r in got} == dict(rows)


def test_migration(spark, tmp_path):
    root = tmp_path / "in"
    folder = root / "Relief Record Scans" / "JPG" / "Box 1" / "7-Doe"
    folder.mkdir(parents=True)
    for name, text in (("p_jpg.txt", json.dumps({"x": [1], "relative_path": "old", "metadata": {"k": 1}})), ("p.jpg", "i"), ("lone.json", "{}"), ("bad_jpg.json", "{"), ("bad.jpg", "i"), ("n.png.json", "{}"), ("n.png", "i")):
        (folder / name).write_text(text)
    (root / "top.json").write_text('{"y": null}')
    (root / "top.JPG").write_text("i")
    files = archive.list_files(spark, str(root)).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    records = spark.createDataFrame([(str(p), p.read_text()) for p in root.rglob("*") if p.suffix in (".json", ".txt")], "path string, content string")
    done = archive.migrated(records, archive.paired_images(files), str(root))
    got = {Path(r.path).name: r for r in done.collect()}
    assert {n: r.status for n, r in got.items()} == {"p_jpg.txt": "copied", "lone.json": "mismatch", "bad_jpg.json": "error", "n.png.json": "copied", "top.json": "copied"}
    one = json.loads(got["p_jpg.txt"].document)
    at = "Relief Record Scans/JPG/Box 1/7-Doe"
    assert one["x"] == [1] and one["relative_path"] == f"{at}/p_jpg.json" and one["metadata"] == {"k": 1, "migrated_from": str(folder / "p_jpg.txt")}
    assert (one["person_folder"], one["person_id"], one["person_name"], one["collection"]) == ("7-Doe", "7", "Doe", "Relief Record Scans")
    assert one["archive_structure"] == {"format": "JPG", "physical_box": "Box 1", "path_components": at.split("/")}
    top = json.loads(got["top.json"].document)
    assert top["relative_path"] == "top.json" and top["archive_structure"]["path_components"] == [] and top["y"] is None
    assert got["lone.json"].error == "No matching image found for lone.json" and got["bad_jpg.json"].error.startswith("Invalid JSON in ")
    assert tuple(archive.migration_counts(files, done).first()) == (5, 4, 3, 1, 1)


def test_status_and_tree(spark):
    paths = ["/r/a/1.jpg", "/r/a/1.jpg.json", "/r/a/2.PNG", "/r/a/2.PNG.txt", "/r/a/3.tif", "/r/b/c/4.gif", "/r/b/c/4.gif.json", "/r/b/c/4.gif.txt", "/r/b/c/d/e/5.bmp", "/r/x.txt", "/other/y.txt"] + [f"/r/many/{i}.txt" for i in range(9)]
    got = {r.directory: tuple(r)[1:] for r in archive.directory_status(listing(spark, paths)).collect()}
    assert got == {None: (5, 2, 1, 2, 40.0), "/r/a": (3, 1, 1, 1, 33.33), "/r/b/c": (1, 1, 0, 0, 100.0), "/r/b/c/d/e": (1, 0, 0, 1, 0.0)}
    assert {r.extension: r.n for r in archive.extension_counts(listing(spark, paths)).collect()} == {".jpg": 1, ".png": 1, ".tif": 1, ".gif": 1, ".bmp": 1}
    tree = {r.directory: (r.dirs, r.files) for r in archive.short_tree(listing(spark, paths), "/r/").collect()}
    assert tree == {".": (["a", "b", "many"], ["x.txt"]), "a": ([], ["1.jpg", "1.jpg.json", "2.PNG", "2.PNG.txt", "3.tif"]), "b": (["c"], []), "b/c": (["d"], ["4.gif", "4.gif.json", "4.gif.txt"]), "many": ([], [f"{i}.txt" for i in range(5)])}
    assert archive.directory_status(listing(spark, [])).where("directory is not null").count() == 0


def test_only_the_result_stays(spark):
    from tessera.session import materialize, materialize_alone, scratch_dir

    def folders():
        root = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
        return {s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)}

    before = folders()

    def build():
        one = materialize(spark.range(5), "alone-one")
        two = materialize_alone(lambda: materialize(one.selectExpr("id + 1 AS id"), "alone-deep").selectExpr("id * 2 AS id"), "alone-two")
        return one.union(two)

    out = materialize_alone(build, "alone-out")
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 2, 3, 4, 4, 6, 8, 10]
    assert [f.rpartition("-")[0] for f in folders() - before] == ["alone-out"]
