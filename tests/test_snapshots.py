"""Tables kept as versions, listings, and snapshots of the inventory and what hangs on it: literal cases with nulls, repeats and empty tables."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from foldergraph.operators import embeddings, folders, inventory, listing, refine
from foldergraph.plans.suggest import save_suggestions, saved_suggestions
from foldergraph.sources.files import scan_directory
from foldergraph.sources.snapshots import Snapshots, dealt_by

ROWS = "id long, model string, v int, _n string"


def test_versions(spark, tmp_path):
    saved, folder = Snapshots(spark, f"file://{tmp_path}/t"), F.col("model")
    rows = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "x"), (3, "b/c ü", 3, None), (4, None, 4, "x")], ROWS)
    assert saved.version() == {"version": None, "tables": {}}
    assert saved.commit({"t": (rows.withColumnRenamed("_n", "n"), folder), "empty": (rows.limit(0).drop("_n"), folder)}) == {"t": ["a", "b/c ü", "none"], "empty": []}
    assert {tuple(r) for r in saved.read("t").collect()} == {tuple(r) for r in rows.collect()} and saved.read("empty").count() == 0
    assert {r.id for r in saved.read("t", ["a", "nowhere"]).collect()} == {1, 2} and saved.read("t", []).count() == 0
    before = saved.version()["tables"]["t"]["folders"]
    changes = spark.createDataFrame([(2, "a", 20, "y"), (9, "new", 9, "y")], ROWS).withColumnRenamed("_n", "n")
    put = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new)
    assert saved.update("t", changes, folder, put) == ["a", "new"]
    assert {(r.id, r.v) for r in saved.read("t").collect()} == {(1, 1), (2, 20), (3, 3), (4, 4), (9, 9)}
    after = saved.version()["tables"]["t"]["folders"]
    assert {f for f in before if before[f] == after[f]} == {"b/c ü", "none"} and before["a"] != after["a"]
    # a folder that lost its rows goes, an update without changes writes nothing, rows of other folders are an error
    assert saved.update("t", changes.filter("id = 9"), folder, lambda old, new: old.limit(0)) == ["new"]
    assert "new" not in saved.version()["tables"]["t"]["folders"]
    version = saved.version()
    assert saved.update("t", changes.limit(0), folder, put) == [] and saved.version() == version
    with pytest.raises(ValueError):
        saved.update("t", changes.filter("id = 2"), folder, lambda old, new: old.withColumn("model", F.lit("c")))
    assert saved.version() == version


def test_a_writer_that_another_overtook_stops(spark, tmp_path):
    saved = Snapshots(spark, str(tmp_path))
    rows = spark.range(5)
    saved.commit({"t": (rows, dealt_by("id"))})

    def late(old, new):
        Snapshots(spark, str(tmp_path)).commit({"t": (rows.limit(2), dealt_by("id"))})
        return new

    # the update's own commit begins after the other's, so it sees it; a commit that began before must not
    version = saved.version()
    saved.update("t", rows.limit(1), dealt_by("id"), late)
    with pytest.raises(RuntimeError):
        saved._point(version["version"], {"version": "x", "tables": {}})


def test_a_stopped_run_leaves_the_old_suggestions_whole(spark, tmp_path, monkeypatch):
    heads = lambda n: spark.createDataFrame([(k, 3 + k % 2, f"s{k}") for k in range(n)], "cluster_id long, n_files long, name string")
    members = lambda n: spark.createDataFrame([(k, f) for k in range(n) for f in (1, 2, 2)], "cluster_id long, file_id long")
    save_suggestions(heads(3), members(4), str(tmp_path))
    read = lambda: [sorted(map(tuple, x.collect())) for x in saved_suggestions(spark, str(tmp_path))]
    old = read()
    assert old == [[(k, 3 + k % 2, f"s{k}") for k in range(3)], [(k, f) for k in range(3) for f in (1, 2)]]
    monkeypatch.setattr(Snapshots, "_point", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        save_suggestions(heads(6), members(6), str(tmp_path))
    assert read() == old
    monkeypatch.undo()
    save_suggestions(heads(6), members(6), str(tmp_path), 4)
    assert read() == [[(k, 4, f"s{k}") for k in (1, 3, 5)], [(k, f) for k in (1, 3, 5) for f in (1, 2)]]


def test_listings(spark, tmp_path):
    for name in ("a.TXT", "_b.md", ".hidden", "sub/_deep/c", "sub/.no/d", "empty dir/e f.csv", "ü.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * len(name))
    (tmp_path / "bare").mkdir()
    os.utime(tmp_path / "a.TXT", (1_000_000_000, 1_000_000_000))
    want = {("a.TXT", ".txt"), ("_b.md", ".md"), ("c", ""), ("e f.csv", ".csv"), ("ü.txt", ".txt")}
    for top in (str(tmp_path), f"file://{tmp_path}/"):
        found = scan_directory(spark, top, 7).collect()
        assert {(r.name, r.extension) for r in found} == want and {r.watched_dir_id for r in found} == {7} and all(r.path == f"{r.parent_dir}/{r.name}" for r in found)
    assert {r.parent_dir for r in found} == {str(tmp_path), f"{tmp_path}/sub/_deep", f"{tmp_path}/empty dir"}
    assert {r.name: r.size for r in found}["a.TXT"] == 5
    assert {r.name for r in scan_directory(spark, str(tmp_path), 1, datetime.datetime(2010, 1, 1, tzinfo=datetime.UTC)).collect()} == {n for n, _ in want} - {"a.TXT"}
    assert scan_directory(spark, str(tmp_path / "bare"), 1).count() == 0


FILES = "file_id long, path string, parent_dir string, status string, watched_dir_id long, extra string"


def test_mark_missing(spark):
    files = spark.createDataFrame([(1, "/a/x", "/a", "active", 1, None), (2, "/a/y", "/a", "active", 1, "e"), (2, "/a/y", "/a", "active", 1, "e"), (3, "/b/z", "/b", "active", 1, None), (4, "/a/o", "/a", "missing", 1, None), (5, None, "/a", "active", 1, None), (6, "/a/s", "/a", None, 1, None)], FILES)
    scan = spark.createDataFrame([("/a/x", "/a"), ("/a/x", "/a"), (None, None)], "path string, parent_dir string")
    state = lambda df: sorted((r.file_id, r.status) for r in df.collect())
    assert state(inventory.mark_missing(files, scan)) == [(1, "active"), (2, "missing"), (2, "missing"), (3, "active"), (4, "missing"), (5, "missing"), (6, None)]
    assert dict(state(inventory.mark_missing(files, scan, True)))[3] == "missing"
    assert state(inventory.mark_missing(files, scan.limit(0))) == state(files) and inventory.mark_missing(files.limit(0), scan).count() == 0


def test_cascade_delete(spark):
    dirs = spark.createDataFrame([(1, "/w/a/"), (2, "/w/ab"), (3, None)], "id long, path string")
    files = spark.createDataFrame([(1, "/w/a/x", "/w/a", "active", 1, None), (2, "/w/ab/y", "/w/ab", "active", 2, None), (3, "/n", "/", "active", None, None)], FILES)
    ids = spark.createDataFrame([(1,), (1,), (2,), (2,), (None,), (9,)], "file_id long")
    guards = spark.createDataFrame([("/w/a", True), ("/w/a/in", False), ("/w/ab", True), (None, True)], "path string, guarded boolean")
    out = inventory.cascade_delete({"watched_dirs": dirs, "files": files, "contents": ids, "comments": ids, "guards": guards}, 1)
    assert {r.id for r in out["watched_dirs"].collect()} == {2, 3} and {r.file_id for r in out["files"].collect()} == {2, 3}
    assert sorted(r.file_id for r in out["contents"].collect()) == [2, 2] and {r.path for r in out["guards"].collect()} == {"/w/ab", None}
    same = inventory.cascade_delete({"watched_dirs": dirs, "files": files.limit(0), "guards": guards}, 5)
    assert same["files"].count() == 0 and same["guards"].count() == 4


def test_merge_extracted(spark):
    schema = "file_id long, processing_status string, content_indexed_at timestamp, processing_error string, file_metadata string"
    files = spark.createDataFrame([(1, "queued", None, "old", "{}"), (2, "queued", None, None, "{}"), (3, "stale", None, "kept", "{}"), (None, "queued", None, None, "{}")], schema)
    results = spark.createDataFrame([(1, None, '{"lines":1}'), (2, "e" * 600, '{"lines":2}'), (9, None, "x")], "file_id long, error string, file_metadata string")
    now = F.to_timestamp(F.lit("2025-01-01"))
    got = {r.file_id: (r.processing_status, r.content_indexed_at is not None, r.processing_error, r.file_metadata) for r in inventory.merge_extracted(files, results, now).collect()}
    assert got == {1: ("processed", True, None, '{"lines":1}'), 2: ("failed", False, "e" * 500, "{}"), 3: ("stale", False, "kept", "{}"), None: ("queued", False, None, "{}")}
    assert inventory.merge_extracted(files, results.limit(0), now).exceptAll(files).count() == 0


def test_decide_guards(spark):
    guards = spark.createDataFrame([("/a", False, "m", "llm"), ("/a/b", True, "m", "llm"), ("/ab", True, "m", "llm"), ("/c", True, "m", "user")], "path string, guarded boolean, reason string, source string")
    made = spark.createDataFrame([("/a", False, 1), ("/a", True, 2), ("/c", False, 5), ("/c", True, 5), ("/c", True, 4), ("/d", False, None)], "path string, guarded boolean, decided_at int")
    got = {r.path: (r.guarded, r.source) for r in folders.decide_guards(guards, made).collect()}
    assert got == {"/a": (True, "user"), "/ab": (True, "llm"), "/c": (True, "user"), "/d": (False, "user")}  # of a tie the guarding one counts
    assert {r.path for r in folders.decide_guards(guards, made.limit(0)).collect()} == {"/a", "/a/b", "/ab", "/c"} and folders.decide_guards(guards.limit(0), made).count() == 3


def test_own_keywords(spark):
    files = spark.createDataFrame([(1, "red red blue"), (2, "red green"), (3, None), (4, "red")], "file_id long, content string")
    members = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1), (8, 99)], "suggestion_id long, file_id long")
    got = {(r.suggestion_id, r.file_id, r.term): (round(r.score, 4), r.place) for r in refine.own_keywords(members, files).collect()}
    assert got == {(7, 1, "blue"): (1.0986, 1), (7, 1, "red"): (0.8109, 2), (7, 2, "green"): (1.0986, 1), (7, 2, "red"): (0.4055, 2), (8, 1, "red"): (1.3863, 1), (8, 1, "blue"): (0.6931, 2)}
    assert refine.own_keywords(members.limit(0), files).count() == 0 and refine.own_keywords(members, files.limit(0)).count() == 0


def test_a_path_that_a_scan_has_twice(spark):
    scan = spark.createDataFrame([("/a/x", "x", ".t", s, "/a", 1, d) for s, d in ((1, "2024-01-01"), (2, "2024-01-03"), (3, "2024-01-02"), (2, "2024-01-03"))] + [(None, "n", ".t", 9, "/a", 1, "2024-01-01"), ("/a/y", None, None, None, None, None, None)], "path string, name string, extension string, size long, parent_dir string, watched_dir_id long, d string")
    scan = scan.withColumn("modified_at", F.to_timestamp("d")).drop("d")
    files = spark.createDataFrame([], "file_id long, path string, name string, extension string, size long, parent_dir string, watched_dir_id long, modified_at timestamp, status string, processing_status string, indexed_at timestamp, content_indexed_at timestamp, processing_error string")
    now = F.to_timestamp(F.lit("2025-01-01"))
    out = inventory.upsert_scan(files, scan, now)
    assert {(r.file_id, r.path, r.size) for r in out.collect()} == {(1, "/a/x", 2), (2, "/a/y", None)}
    again = inventory.upsert_scan(out, scan.filter("path = '/a/x' AND size = 3"), now)
    assert {(r.path, r.size, r.processing_status) for r in again.collect()} == {("/a/x", 3, "stale"), ("/a/y", None, "unprocessed")}
    assert inventory.upsert_scan(files, scan.limit(0), now).count() == 0 and inventory.upsert_scan(out, scan.limit(0), now).count() == 2


def test_contents_and_vectors_of_odd_ids(spark):
    keys = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "file_id long")
    contents = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (9, "c")], "file_id long, content string")
    assert sorted(((r.file_id, r.content) for r in listing.fetch_contents(keys, contents).collect()), key=repr) == [(1, "b"), (1, "b"), (2, ""), (3, ""), (None, "")]
    big = 2**60 + 1
    texts = spark.createDataFrame([(big, "x"), (None, "yy"), (big, None)], "file_id long, text string").coalesce(1)
    got = [(r.file_id, r.embedding) for r in embeddings.embed_batches(texts, lambda ts: [[float(len(t))] for t in ts]).collect()]
    assert sorted(got, key=repr) == sorted([(big, [1.0]), (None, [2.0]), (big, [0.0])], key=repr)
    assert embeddings.embed_batches(texts.limit(0)).count() == 0
