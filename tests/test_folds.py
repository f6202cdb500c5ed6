"""Change sets, ranks, pages, replies, guard walks and move plans against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from foldergraph.operators import folders, inventory, listing, refine
from foldergraph.operators.skew import rank_in_key
from foldergraph.sources import shared

TABLE = "id long, part string, name string, seen long"


def _applied(table, changes, keep):
    """One change after the other."""
    rows = [dict(zip(("id", "part", "name", "seen"), r)) for r in table]
    for at, seq, i, part, op, name, seen in sorted(changes, key=lambda c: (c[0] is not None, c[0] or 0, c[1])):
        if i is None or part is None:
            continue
        own = [r for r in rows if (r["id"], r["part"]) == (i, part)]
        if op == "delete":
            rows = [r for r in rows if r not in own]
        elif op in ("insert", "upsert") and not own:
            rows.append({"id": i, "part": part, "name": name, "seen": seen})
        elif op in ("update", "upsert"):
            for r in own:
                for c, value in (("name", name), ("seen", seen)):
                    if c in keep:
                        r[c] = value if r[c] is None and op == "upsert" else r[c]
                    elif value is not None:
                        r[c] = value
    return collections.Counter(tuple(r.values()) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_change_sets_equal_row_by_row(spark, seed):
    rnd = random.Random(seed)
    pick = lambda *xs: rnd.choice(xs)
    table = [(k, "p", pick(None, "old"), pick(None, 5)) for k in range(0, 40, 2)] + [(None, "p", "n", 1), (4, None, "n", 1), (6, "p", "twice", None)]
    changes = [(pick(None, 1, 2, 3), s, pick(0, 0, 1, *range(40)), "p", pick("delete", "insert", "update", "upsert", "upsert", "strange"), pick(None, f"n{s}"), pick(None, s)) for s in range(300)]
    changes += [(1, 900, None, "p", "upsert", "x", 1), (1, 901, 3, None, "upsert", "x", 1)]
    frame = spark.createDataFrame([(i, p, name, seen, op, at, s, "x") for at, s, i, p, op, name, seen in changes], TABLE + ", op string, changed_at int, sequence long, _salt string").drop("_salt").repartition(3)
    old = spark.createDataFrame(table, TABLE)
    got = inventory.apply_changes(old, frame, ["id", "part"], keep=("seen",)).collect()
    assert collections.Counter(map(tuple, got)) == _applied(table, changes, ("seen",))


def test_change_sets_cases(spark):
    old = spark.createDataFrame([(1, "p", "old", 0), (2, "p", "b", 0)], TABLE)
    made = lambda *rows: spark.createDataFrame([(*r[:2], r[2], None, *r[3:]) for r in rows], TABLE + ", op string, changed_at int")
    rows = made((1, "p", None, "delete", 1), (1, "p", "new", "insert", 2), (2, "p", "c", "upsert", 1), (2, "p", None, "upsert", 2), (2, "p", "c", "upsert", 1))
    assert {tuple(r) for r in inventory.apply_changes(old, rows, ["id", "part"]).collect()} == {(1, "p", "new", None), (2, "p", "c", 0)}
    tie = made((3, "p", "b", "upsert", 1), (3, "p", "a", "upsert", 1))
    once = [inventory.apply_changes(old, tie.orderBy(F.col("name").desc() if k else "name"), ["id", "part"]).filter("id = 3").collect() for k in range(2)]
    assert once[0] == once[1] and len(once[0]) == 1
    assert inventory.apply_changes(old, rows.limit(0), ["id", "part"]).count() == 2
    assert {tuple(r) for r in inventory.apply_changes(old.limit(0), rows, ["id", "part"]).collect()} == {(1, "p", "new", None), (2, "p", "c", None)}


def test_ranks_inside_keys(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", None, *"abcdefgh"]), rnd.choice([None, *range(30)]), k) for k in range(600)]
    frame = spark.createDataFrame(rows, "key string, v int, row int").repartition(3)
    got = rank_in_key(frame, ["key"], [F.col("v").desc_nulls_last(), "row"], "place")
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: k for k, r in enumerate(own)}
    assert {r.row: r.place for r in got.collect()} == want and got.columns == ["key", "v", "row", "place"]
    assert rank_in_key(frame.limit(0), ["key"], ["v"]).count() == 0
    one = rank_in_key(spark.range(1000).selectExpr("id", "1 AS k"), ["k"], ["id"]).collect()
    assert all(r.rank == r.id for r in one) and len(one) == 1000


def test_a_hot_key_gives_no_task_more_than_a_range(spark, monkeypatch):
    """The window that numbers rows sees a key in the pieces that the ranges cut it to."""
    seen = []
    keep = shared.cut

    def watched(df, name, codec="zstd"):
        out = keep(df, name, codec)
        if name == "ranked":
            seen.append(max(r["count"] for r in out.groupBy("_range").count().collect()))
        return out

    monkeypatch.setattr("foldergraph.operators.skew.cut", watched)
    rank_in_key(spark.range(4000).selectExpr("id", "if(id % 3 = 0, -1, id) AS k"), ["k"], ["id"]).count()
    assert seen and seen[0] < 4000 / 4 * 1.5


def test_pages(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, *"abc"])) for k in range(500)]
    frame = spark.createDataFrame(rows, "file_id long, name string").repartition(3)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    for limit, offset in ((10, 0), (7, 333), (50, 480), (5, 900), (0, 3), (500, 0)):
        for direct in (0, 10_000):
            got = [tuple(r) for r in listing.page(frame, ["name", "file_id"], limit, offset, direct).collect()]
            assert got == order[offset : offset + limit]
    assert listing.page(frame.limit(0), ["name", "file_id"], 5, 5, 0).count() == 0


def test_a_page_far_down_reads_two_ranges_at_most(spark):
    page = listing.page(spark.range(40_000).select(F.col("id").alias("file_id")), ["file_id"], 20, 30_000, 0)
    assert [r[0] for r in page.collect()] == list(range(30_000, 30_020))
    assert len({f.rpartition("_range=")[2].partition("/")[0] for f in page.inputFiles()}) <= 2


def test_first_files_of_folders_and_summaries(spark):
    rows = [(k, "/a/" if k % 2 else "/a\\b", "active" if k % 5 else "missing", None if k % 7 == 0 else f"n{k % 4}") for k in range(60)] + [(None, "/a", "active", "x")]
    files = spark.createDataFrame(rows, "file_id long, parent_dir string, status string, name string")
    got = {(r.folder, r.file_id): r.place for r in listing.files_in_folders(files, spark.createDataFrame([("/a",), ("/a",)], "path string"), 4).collect()}
    assert got == {("/a", 59): 1, ("/a", 57): 2, ("/a", 53): 3, ("/a", 51): 4}
    members = files.filter("file_id IS NOT NULL").selectExpr("file_id % 3 AS suggestion_id", "file_id")
    out = {r.suggestion_id: (r.file_count, r.preview) for r in listing.suggestion_summary(members, files, 3).collect()}
    for s in range(3):
        names = sorted(r[3] for r in rows[:60] if r[0] % 3 == s and r[3])
        assert out[s] == (20, ", ".join(names[:3]))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"related": true, "removed": [2, 99]}', (True, [2, 99])),
        (' ```json\n{"related": false}\n``` ', (False, None)),
        ('{"x": {"related": 1}, "related": null, "removed": []}', (None, [])),
        ('{"removed": [1, null]}', (None, [1, None])),
        *[(raw, None) for raw in ('{"related": "yes"}', '{"removed": [1.5]}', '{"removed": [1.0]}', '{"removed": "x"}', '{"removed": [1, "2"]}', '{"name": 3}', '{"reason": []}', "", "null", "[]", '[{"related": true}]')],
        *[(raw, None) for raw in ('{"related": true} {"related": false}', '{"related": true}] [{"related": true}', '{"related": true}, {}', '{"related": true}}', '{"related": true} x', '{"related": tru', None)],
    ],
)
def test_replies_are_read_strictly(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "raw string").select(refine.parsed_reply(F.col("raw")).alias("r")).head().r
    assert (None if r is None else (r.related, r.removed)) == want


def test_refinements(spark):
    suggestions = spark.createDataFrame([(k, f"s{k}", "d") for k in range(8)], "suggestion_id long, name string, description string")
    members = spark.createDataFrame([(k, f) for k in range(8) for f in (30, 10, 20)], "suggestion_id long, file_id long")
    raws = {0: '{"related": true, "removed": [1, 3, 7, null]}', 1: '{"related": false}', 2: '{"related": "yes"}', 3: '{"removed": [1.5]}', 4: '{"related": true} {"related": false}', 5: '{"related": true, "name": "n", "description": "e"}', 6: None}
    replies = spark.createDataFrame([*raws.items(), (5, "{}}"), (None, '{"related": false}'), (99, '{"related": false}')], "suggestion_id long, raw string")
    new, left = refine.apply_refinements(suggestions, members, replies.filter("suggestion_id IS NULL OR suggestion_id <> 5 OR raw <> '{}}'"))
    assert {r.suggestion_id: (r.name, r.description) for r in new.collect()} == {k: ("n", "e") if k == 5 else (f"s{k}", "d") for k in range(8) if k != 1}
    kept = collections.defaultdict(set)
    for r in left.collect():
        kept[r.suggestion_id].add(r.file_id)
    assert kept == {k: {20} if k == 0 else {10, 20, 30} for k in range(8) if k != 1}
    assert sum(r.unread for r in refine.read_replies(replies).collect()) == 4
    new, left = refine.apply_refinements(suggestions, members, replies.limit(0))
    assert new.count() == 8 and left.count() == 24


def test_nothing_below_a_guarded_folder_is_asked_about(spark, tmp_path):
    paths = ["/r/app/src/a/b", "/r/app/doc", "/r/mix/x/y/z/deep", "/r/mix/odd", "/r/known/in", "/r/user/in", "/r/fail/in"]
    files = spark.createDataFrame([(k, p, f"f{k}") for k, p in enumerate(paths)] + [(90, "/r/mix", None)], "file_id long, parent_dir string, name string")
    tree = folders.folder_tree(files, "/r")
    known = spark.createDataFrame([("/r/known", True, "llm"), ("/r/user", False, "user"), ("/r/user", True, "llm"), ("/r/mix", False, "llm")], "path string, guarded boolean, source string")
    log = str(tmp_path)

    def ask(prompt):
        name = prompt.partition("named ")[2].partition(".\n")[0]
        with open(f"{log}/{name}", "a") as out:
            out.write(prompt + "\0")
        if name == "fail":
            raise OSError("gone")
        return '{"related": 1}' if name == "odd" else '{"related": %s, "reason": "said"}' % ("true" if name == "app" else "false")

    got = {r.path: (r.guarded, r.how, r.reason) for r in folders.walk_guards(tree, known, refine.prompted(tree, files, ask)).collect()}
    no = (False, "classified", "said")
    assert got == {
        "/r/app": (True, "classified", "said"), "/r/mix": no, "/r/known": (True, "known", None), "/r/user": (False, "known", None), "/r/fail": (False, "failed", "gone"),
        "/r/mix/x": no, "/r/mix/odd": (False, "failed", "reply not understood"), "/r/user/in": no, "/r/fail/in": no, "/r/mix/x/y": no, "/r/mix/x/y/z": (True, "too deep", None),
    }
    asked = {p.name: p.read_text().count("\0") for p in tmp_path.iterdir()}
    assert asked == {"app": 1, "mix": 1, "fail": 1, "x": 1, "odd": 1, "in": 2, "y": 1}
    prompt = (tmp_path / "x").read_text()
    assert "The folder above it, mix, holds a mixture." in prompt and "Folders in it: y\n" in prompt and "one a line:\nnone\n" in prompt
    assert folders.walk_guards(tree.limit(0), known, refine.prompted(tree, files, ask)).count() == 0


def test_prompts_name_the_first_of_many(spark):
    files = spark.createDataFrame([(k, "/r/a", f"f{k:03}") for k in range(50)], "file_id long, parent_dir string, name string")
    tree = folders.folder_tree(files, "/r")
    prompt = refine.folder_prompts(tree.filter("depth = 1"), tree, files, 3).head().prompt
    assert "one a line:\nf000\nf001\nf002\nIs" in prompt
    members = spark.createDataFrame([(1, k) for k in range(50)], "cluster_id long, file_id long")
    words = spark.createDataFrame([(0, "w", 1), (1, "later", 9)], "file_id long, term string, place int")
    prompt = refine.cluster_prompts(members, files, words, most=2).head().prompt
    assert "\n1. f000 (in /r/a): w\n2. f001 (in /r/a): \nand 48 more\n" in prompt


def test_prompts_of_clusters_name_all_files(spark):
    """Without a limit given, a cluster of more than LIST_LIMIT files names them all, as the SQL of refine_prompt does."""
    n = 10_020
    members = spark.range(n).selectExpr("1L AS cluster_id", "id AS file_id")
    files = spark.range(n).selectExpr("id AS file_id", "'/r' AS parent_dir", "concat('f', id) AS name")
    words = spark.createDataFrame([(0, "w", 1), (n - 1, "last", 2)], "file_id long, term string, place int")
    lines = refine.cluster_prompts(members, files, words).head().prompt.split("\n")
    assert lines[2:-1] == [f"{k + 1}. f{k} (in /r): {'w' if k == 0 else 'last' if k == n - 1 else ''}" for k in range(n)]


def test_coherent_folders_stand_for_a_model(spark):
    files = spark.createDataFrame([(1, "/r/a"), (2, "/r/a"), (3, "/r/a/"), (4, "/r/b"), (5, "/r/b"), (6, "/r/b"), (7, "/r/c")], "file_id long, folder string")
    words = spark.createDataFrame([(k, "same" if k < 4 else f"t{k}", 1.0) for k in range(1, 8)], "file_id long, term string, score double")
    tree = folders.folder_tree(files.withColumnRenamed("folder", "parent_dir"), "/r")
    known = spark.createDataFrame([], "path string, guarded boolean, source string")
    got = {r.path: (r.guarded, r.reason) for r in folders.walk_guards(tree, known, folders.coherent_folders(files, words)).collect()}
    assert got == {"/r/a": (True, "coherence 1.0"), "/r/b": (False, "coherence 0.0"), "/r/c": (False, "few files")}


@pytest.mark.parametrize("seed", range(3))
def test_move_plans_equal_one_by_one(spark, seed):
    rnd = random.Random(seed)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "a_1_2.txt", "a_01.txt", "b", "b_1", "b_1_1", "b_10", ".x", "_1.x", "c.tar.gz", "a_.txt", "", None]
    rows = [(k, rnd.choice(names), rnd.randrange(2)) for k in range(90)]
    there = sorted({(f"f{rnd.randrange(2)}", rnd.choice([*names[:-1], "a_3.txt", "a_5.txt", "b_2", "b_1_3", "_2"])) for _ in range(24)}) if seed else []
    want = set()
    for s in range(2):
        taken = {n for f, n in there if f == f"f{s}"}
        for name, k in sorted((n or "", k) for k, n, own in rows if own == s):
            base, dot, ext = name.rpartition(".")
            base, ext = (base, dot + ext) if dot else (name, "")
            new, i = name, 0
            while new in taken:
                i += 1
                new = f"{base}_{i}{ext}"
            taken.add(new)
            want.add((s, k, new))
    files = spark.createDataFrame([(k, n) for k, n, _ in rows], "file_id long, name string")
    members = spark.createDataFrame([(s, k) for k, _, s in rows] + [(0, 999)], "suggestion_id long, file_id long")
    heads = spark.createDataFrame([(s, f"f{s}") for s in range(2)], "suggestion_id long, name string")
    out = refine.move_plan(members, files, heads, spark.createDataFrame(there, "folder string, name string") if there else None)
    assert {(r.suggestion_id, r.file_id, r.new_name) for r in out.collect()} == want
    assert refine.move_plan(members.limit(0), files, heads).count() == 0


def test_prompt_queries_name_all_of_a_folder(spark, tmp_path):
    """The SQL of the queries knows no limit of names, so a folder of more than LIST_LIMIT files names them all."""
    import hashlib

    from foldergraph.plans.queries import QUERIES

    names = [f"p{k:05}.html" for k in range(10_020)]
    rows = [(k, f"https://a.org/x/{name}", "h") for k, name in enumerate(names)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.path: r.prompt for r in QUERIES["guard_prompt_classify"](spark, str(tmp_path)).collect()}
    ask = 'Is what it holds one thing, such as the parts of a program or a project? Answer with JSON only: {"related": true, "reason": ""}'
    path = max(got, key=len)
    above = path.split("/")[-2]
    prompt = f"There is a folder named x.\nThe folder above it, {above}, holds a mixture.\nFolders in it: none\nIts files, one a line:\n" + "\n".join(names) + f"\n{ask}"
    assert got[path] == hashlib.md5(prompt.encode()).hexdigest()
