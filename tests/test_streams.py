import datetime as dt
import json
import random

import pytest

from tessera.streaming import ingestion, state
from tessera.streaming.events import run_to_end

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"


def events(n, users=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=rng.randint(0, 6 * 3600))
        rows.append((i, rng.randrange(users) if i % 17 else None, rng.choice(["view", "error", None]), float(i), at))
    return sorted(rows, key=lambda r: r[4])


def plain_progress(rows, idle):
    seen, closed, last = {}, [], {}
    for i, user, kind, _, at in sorted(rows, key=lambda r: (r[4], r[0])):
        n, e, before = last.get(user, (0, 0, None))
        if before is not None and (at - before).total_seconds() >= idle:
            closed.append((user, before, n, e))
            n = e = 0
        last[user] = n + 1, e + (kind == "error"), at
        seen[i] = last[user][:2]
    closed += [(user, at, n, e) for user, (n, e, at) in last.items()]
    return seen, closed


@pytest.fixture()
def store(spark):
    before = spark.conf.get(state.STORE[0])
    state.with_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield spark
    spark.conf.set(state.STORE[0], before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def millis(at):
    return int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def feed(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        yield i


def test_live_progress_equals_batch(store, tmp_path):
    spark, rows = store, events(240)
    seen, closed = plain_progress(rows, 1800)
    # Arrival is out of order by less than the watermark allows.
    rng = random.Random(5)
    arrival = sorted(rows, key=lambda r: r[4] + dt.timedelta(seconds=rng.randint(0, 500)))
    parts = [arrival[i : i + 80] for i in range(0, 240, 80)]
    out = str(tmp_path / "out")
    for _ in feed(spark, tmp_path / "in", parts):
        live = state.live_progress(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 1800, "10 minutes")
        run_to_end(live, out, str(tmp_path / "cp"))
    got = spark.read.parquet(out).collect()
    mine = {r.event_id: (r.seen, r.errors) for r in got if r.kind == "seen"}
    passed = millis(max(r[4] for r in rows)) - 600_000
    # Everything that the watermark has passed is there, each once, and as in the batch.
    assert len(mine) == sum(r.kind == "seen" for r in got) and all(seen[i] == v for i, v in mine.items())
    assert set(mine) == {r[0] for r in rows if millis(r[4]) <= passed}
    ends = sorted((str(r.key), r.at, r.seen, r.errors) for r in got if r.kind == "closed")
    assert ends == sorted((str(u), millis(at), n, e) for u, at, n, e in closed if millis(at) + 1_800_000 <= passed)
    batch = {r.event_id: (r.seen, r.errors) for r in state.session_progress(spark.createDataFrame(rows, SCHEMA), 1800).collect()}
    assert batch == seen


def test_late_rows_are_dropped(store, tmp_path):
    spark = store
    at = lambda m: START + dt.timedelta(minutes=m)
    parts = [[(1, 1, "view", 0.0, at(0)), (2, 1, "view", 0.0, at(100))], [(3, 1, "error", 0.0, at(5)), (4, 1, "view", 0.0, at(120))], [(5, 1, "view", 0.0, at(200))]]
    for _ in feed(spark, tmp_path / "in", parts):
        live = state.live_progress(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 3600, "10 minutes")
        run_to_end(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.at, r.kind, r.event_id, r.seen, r.errors) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g[1:] for g in got if g[1] == "seen"] == [("seen", 1, 1, 0), ("seen", 2, 1, 0), ("seen", 4, 2, 0)]
    assert [g[3:] for g in got if g[1] == "closed"] == [(1, 0), (2, 0)]


def test_cached_answers_expire(store, tmp_path):
    spark, rows = store, events(200, users=3, seed=4)
    want, kept = {}, {}
    for i, user, _, value, at in sorted(rows, key=lambda r: (r[4], r[0])):
        hit = user in kept and (at - kept[user][0]).total_seconds() < 1200
        if not hit:
            kept[user] = at, str(value)
        want[i] = hit, millis(kept[user][0]), kept[user][1]
    for _ in feed(spark, tmp_path / "in", [rows[:70], rows[70:150], rows[150:]]):
        live = state.cached_answers(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 1200, "1 minute")
        run_to_end(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.event_id: (r.hit, r.computed_at, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) > 150 and all(want[i] == v for i, v in got.items())
    assert any(v[0] for v in got.values()) and not all(v[0] for v in got.values())


def test_session_progress_of_hot_keys(spark):
    rows = events(3000, users=2, seed=9)
    seen, _ = plain_progress(rows, 60)
    got = state.session_progress(spark.createDataFrame(rows, SCHEMA).repartition(6), 60).collect()
    assert {r.event_id: (r.seen, r.errors) for r in got} == seen
    assert state.session_progress(spark.createDataFrame([], SCHEMA)).count() == 0


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_ingestion_of_a_growing_folder(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    write(folder, "a.json", 'junk \x01{"x": 1, "filename": "own.json"} tail')
    write(folder, "sub/b.TXT", '{"y": {"z": [1, 2]}}')
    write(folder, "sub/copy.json", '{"y": {"z": [1, 2]}}')
    write(folder, "bad.json", "no object here")
    write(folder, "worse.json", '{"x": ')
    write(folder, "broken.json", '{"x": 1,, }')
    write(folder, "escaped.json", '{\\"k\\": \\"v\\"}')
    write(folder, "bytes.txt", b"\xff\xfe{}")
    write(folder, "other.csv", "1,2")
    ingestion.ingest(spark, str(folder), out)
    files = {r.file_path.split("/in/")[1]: r for r in ingestion.ingested_files(spark, out).collect()}
    assert {n: r.status for n, r in files.items()} == {"a.json": "processed", "sub/b.TXT": "processed", "sub/copy.json": "skipped", "bad.json": "failed", "worse.json": "failed", "broken.json": "failed", "escaped.json": "processed", "bytes.txt": "failed"}
    assert files["bad.json"].error == "Error processing file bad.json: " + ingestion.NO_OBJECT and files["broken.json"].error.endswith(ingestion.NOT_VALID) and files["a.json"].error is None
    docs = {r.relative_path: r for r in ingestion.ingested_documents(spark, out).collect()}
    assert {n: (r.filename, json.loads(r.document)) for n, r in docs.items()} == {"a.json": ("own.json", {"x": 1, "filename": "own.json"}), "sub/b.TXT": ("b.TXT", {"y": {"z": [1, 2]}}), "escaped.json": ("escaped.json", {"k": "v"})}

    # A second run over the grown folder takes new files only, and knows the contents of the first.
    write(folder, "new.json", '{"n": 1}')
    write(folder, "again.json", '{"y": {"z": [1, 2]}}')
    ingestion.ingest(spark, str(folder), out)
    ingestion.ingest(spark, str(folder), out)
    every = ingestion.ingested_files(spark, out)
    assert every.count() == 10 and ingestion.ingested_documents(spark, out).count() == 4
    counts = {r.batch: (r.found, r.processed, r.skipped, r.failed) for r in ingestion.run_counts(every).collect()}
    assert counts == {0: (8, 3, 1, 4), 1: (2, 1, 1, 0)}
    shown = [tuple(r) for r in ingestion.progress_events(every).orderBy("batch", "file_path").collect()]
    assert [r[2] for r in shown] == ["complete", "error", "error", "error", "complete", "complete", "skip", "error", "skip", "complete"]
    assert shown[-1][3:] == (4, 2, 4) and shown[0][3:] == (1, 0, 0)
    late = ingestion.events_since(ingestion.progress_events(every), 8).collect()
    assert {r.file_path.split("/")[-1] for r in late} == {"again.json", "new.json"}


def test_ingestion_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(6):
        write(folder, f"{i}.json", json.dumps({"i": i}))
    whole = ingestion.parsed
    calls = []

    def failing(files, root):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return whole(files, root)

    monkeypatch.setattr(ingestion, "parsed", failing)
    with pytest.raises(Exception, match="lost"):
        ingestion.ingest(spark, str(folder), out, files_per_batch=2)
    assert ingestion.ingested_documents(spark, out).count() == 2
    ingestion.ingest(spark, str(folder), out, files_per_batch=2)
    assert sorted(json.loads(r.document)["i"] for r in ingestion.ingested_documents(spark, out).collect()) == list(range(6))
    assert [r.found for r in ingestion.run_counts(ingestion.ingested_files(spark, out)).orderBy("batch").collect()] == [2, 2, 2]


def test_combined_hash(spark):
    import hashlib

    files = spark.createDataFrame([(f"p{i:03d}", hashlib.sha256(bytes([i])).hexdigest()) for i in range(100)], "file_path string, file_hash string").repartition(4)
    hashes = [r.file_hash for r in files.orderBy("file_path").collect()]
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert ingestion.combined_hash(files).first()[0] == sha(hashes)
    level = [sha(hashes[i : i + 7]) for i in range(0, 100, 7)]
    level = [sha(level[i : i + 7]) for i in range(0, len(level), 7)]
    assert ingestion.combined_hash(files, 7).first()[0] == sha(level)
    stored = ingestion.combined_hash(files)
    assert ingestion.unchanged(files, stored) and not ingestion.unchanged(files, None) and not ingestion.unchanged(files.where("file_path <> 'p000'"), stored)
    assert ingestion.combined_hash(files.limit(0)).first()[0] == sha([])
