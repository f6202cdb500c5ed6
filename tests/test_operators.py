import random
import zipfile

import pytest
from pyspark.sql import functions as F

from foldergraph.functions import text as tx
from foldergraph.functions import vectors as vec
from foldergraph.operators import clusters, embeddings, folders, inventory, keywords, refine, similarity
from foldergraph.operators.components import connected_components
from foldergraph.operators.vectors import dbscan
from foldergraph.plans import queries, suggest
from foldergraph.sources import shared
from foldergraph.sources.files import extract_directory, scan_directory


def test_terms(spark):
    out = spark.createDataFrame([("The quick brown fox jumps over the lazy dog 123",), (None,), ("",)], "s string").select(tx.terms(F.col("s"))).collect()
    assert out[0][0] == ["quick", "brown", "fox", "jumps", "over", "lazy", "dog"] and out[1][0] == [] and out[2][0] == []


@pytest.mark.parametrize(("ext", "tag"), [(".pdf", "document"), ("PY", "code"), (".xlsx", "spreadsheet"), (".zzz", None), ("", None)])
def test_tags(spark, ext, tag):
    assert spark.createDataFrame([(ext,)], "e string").select(tx.extension_tag(F.col("e"))).head()[0] == tag


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    out = rows.select(vec.dense_cosine(F.col("a"), F.col("b")).alias("c"), vec.dense_distance(F.col("a"), F.col("b")).alias("d"), vec.normalized(F.col("a")).alias("n")).collect()
    assert [r.c for r in out] == [0.0, 0.0, 0.0, 1.0]
    assert out[0].d == 5.0 and out[1].d == vec.FAR and out[2].d == vec.FAR
    assert out[0].n == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize("task_edges", [1 << 22, 3])
def test_components_against_union_find(spark, monkeypatch, task_edges):
    monkeypatch.setattr("foldergraph.operators.components.TASK_EDGES", task_edges)
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + k, 100 + k + 1) for k in range(30)]
    rnd.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    rows = spark.createDataFrame([*edges, (None, 3), (4, None), *edges[:5]], "src long, dst long").repartition(5)
    got = dict(map(tuple, connected_components(rows).collect()))
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_negative_idf_and_long_lists(spark):
    # a term in content and name counts twice, so that df exceeds the number of files
    files = spark.createDataFrame([(1, "apple.txt", ".txt", "apple apple"), (2, "apple.txt", ".txt", "apple")], "file_id long, name string, extension string, content string")
    entries = {(r.file_id, r.term): (r.tf, r.dup) for r in keywords.merged_entries(files).collect()}
    assert entries[1, "apple"] == (1.0, 2) and entries[1, "text"] == (5.0, 1)
    scores = {(r.file_id, r.term): r.score for r in keywords.tfidf(keywords.merged_entries(files), files).collect()}
    assert scores[1, "apple"] < 0


def test_entries_of_contents_from_another_table(spark):
    rows = [(1, "pear.txt", ".txt", "apple apple pear"), (2, None, None, None), (3, "a.b", ".b", ""), (4, "gone.md", ".md", "gone gone")]
    files = spark.createDataFrame(rows, "file_id long, name string, extension string, content string")
    own = files.filter("file_id < 4")
    want = sorted(map(tuple, keywords.merged_entries(own).collect()))
    assert (1, "apple", 2.0, 1) in want and (1, "pear", 1.0, 2) in want
    contents = files.select("file_id", "content").unionByName(spark.createDataFrame([(None, "apple"), (9, "none of the files")], "file_id long, content string"))
    assert sorted(map(tuple, keywords.merged_entries(own.drop("content"), contents=contents).collect())) == want
    assert keywords.merged_entries(own.limit(0), contents=contents).count() == 0


def test_similar_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(d, f"t{t}", rnd.choice([-0.5, 1.0, 2.0, 3.0])) for d in range(40) for t in rnd.sample(range(12), 4)]
    by = {}
    for d, t, s in rows:
        by.setdefault(d, {})[t] = s
    classes = similarity.profile_classes(spark.createDataFrame(rows, "file_id long, term string, score double"))
    heads = {r.file_id for r in classes.collect() if r.file_id == r.class_id}
    norm = {d: sum(x * x for x in v.values()) ** 0.5 for d, v in by.items()}
    want = {(a, b) for a in heads for b in heads if a < b and sum(x * by[b].get(t, 0) for t, x in by[a].items()) / norm[a] / norm[b] >= 0.45}
    assert {(r.id1, r.id2) for r in similarity.similar_pairs(classes).collect()} == want


def test_cluster_score_and_names(spark):
    classes = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 1)], "file_id long, class_id long, class_size long")
    pairs = spark.createDataFrame([(1, 2, 0.8, 1, 1), (2, 3, 0.6, 1, 1)], "id1 long, id2 long, sim double, n1 long, n2 long")
    found = clusters.class_clusters(classes, pairs)
    assert {(r.class_id, r.cluster_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 1)}
    assert clusters.cluster_scores(found, clusters.pair_sums(found, pairs)).head().score == pytest.approx(0.7)
    members = spark.createDataFrame([(1, 1), (1, 2)], "cluster_id long, file_id long")
    words = spark.createDataFrame([(1, "report", 5.0), (1, "financial", 1.0), (2, "report", 3.0), (2, "budget", 2.0)], "file_id long, term string, score double")
    out = clusters.cluster_terms(members, words).head()
    assert out.terms == "report, budget, financial" and out.name == "report files"


def test_dbscan_against_sequential(spark):
    rnd = random.Random(5)
    points = [(k, [rnd.random() * 4, rnd.random() * 4]) for k in range(60)]
    eps, least = 0.45, 3
    near = {a: [b for b, y in points if sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5 <= eps] for a, x in points}
    label, number = {}, 0
    for a, _ in points:
        if a in label or len(near[a]) < least:
            continue
        number += 1
        todo = [a]
        while todo:
            b = todo.pop()
            if b in label:
                continue
            label[b] = number
            if len(near[b]) >= least:
                todo += [c for c in near[b] if c not in label]
    sizes = {n: list(label.values()).count(n) for n in set(label.values())}
    want = {frozenset(k for k in label if label[k] == n) for n in sizes if sizes[n] >= 3}
    got = {}
    for r in dbscan(spark.createDataFrame(points, "id long, vec array<double>"), eps, least).collect():
        got.setdefault(r.cluster_no, set()).add(r.id)
    assert {frozenset(x) for x in got.values()} == want


def test_escalation_and_guards(spark):
    files = spark.createDataFrame([(1, "/r/a/b/c"), (2, "/r/a/d"), (3, "/r/e/f")], "file_id long, parent_dir string")
    tree = folders.folder_tree(files, "/r")
    guards = spark.createDataFrame([("/r/a/b/c", True), ("/r/a/d", True)], "path string, guarded boolean")
    assert {r.path for r in folders.escalate_guards(tree, guards).collect()} == {"/r/a/b", "/r/a"}
    assert {r.file_id for r in folders.under_guard(files, guards).collect()} == {3}


def test_upsert_twice_changes_nothing(spark):
    scan = spark.createDataFrame([("/a/x.txt", "x.txt", ".txt", 1, "/a", 1, "2024-01-01")], "path string, name string, extension string, size long, parent_dir string, watched_dir_id long, m string").withColumn("modified_at", F.to_timestamp("m")).drop("m")
    empty = spark.createDataFrame([], "file_id long, path string, name string, extension string, size long, parent_dir string, watched_dir_id long, modified_at timestamp, status string, processing_status string, indexed_at timestamp, content_indexed_at timestamp, processing_error string")
    as_of = F.to_timestamp(F.lit("2025-01-01"))
    once = inventory.upsert_scan(empty, scan, as_of)
    twice = inventory.upsert_scan(once, scan, as_of)
    assert once.count() == 1 and once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_replies(spark):
    raws = ['{"related": true, "removed": [1]}', '```json\n{"related": true}\n```', '{"related": tru', '{"related": true} more', ""]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in raws], "raw string").select(refine.parsed_reply(F.col("raw"))).collect()]
    assert [None if x is None else x.related for x in out] == [True, True, None, None, None]


def test_move_plan_collisions(spark):
    files = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "a_1.txt")], "file_id long, name string")
    members = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "suggestion_id long, file_id long")
    out = refine.move_plan(members, files, spark.createDataFrame([(9, "a/b")], "suggestion_id long, name string")).collect()
    assert {(r.file_id, r.new_name, r.folder) for r in out} == {(1, "a.txt", "a_b"), (2, "a_1.txt", "a_b"), (3, "a_1_1.txt", "a_b")}


def test_files_and_office(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.txt").write_bytes(b"plain \xff text")
    (tmp_path / ".hidden").write_text("x")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:t>hello</w:t><w:t>there</w:t></w:d>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:creator>me</dc:creator></c>')
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>one</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<w><c t="s"><v>0</v></c><c><v>7</v></c></w>')
    (tmp_path / "bad.pptx").write_bytes(b"no package")
    out = {r.path.rpartition("/")[2]: r for r in extract_directory(spark, str(tmp_path)).collect()}
    assert out["d.docx"].content == "hello there " and out["d.docx"].metadata == {"author": "me"}
    assert out["s.xlsx"].content == "one 7 " and out["bad.pptx"].error and out["n.txt"].content == "plain  text"
    assert {r.name for r in scan_directory(spark, str(tmp_path), 1).collect()} == {"n.txt", "d.docx", "s.xlsx", "bad.pptx"}
    # packages that can't be unpacked, names below a hidden root, kinds without a reader, a replacement character of the text's own
    top = tmp_path / ".root" / "in"
    top.mkdir(parents=True)
    with zipfile.ZipFile(top / "z.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<d><t>" + "text " * 500 + "</t></d>")
    raw = bytearray((top / "z.docx").read_bytes())
    at = raw.index(b"word/document.xml") + len(b"word/document.xml")
    raw[at : at + 6] = b"\xff" * 6
    (top / "corrupt.docx").write_bytes(raw)
    raw = bytearray((top / "z.docx").read_bytes())
    raw[6] |= 1
    raw[raw.index(b"PK\x01\x02") + 8] |= 1
    (top / "locked.docx").write_bytes(raw)
    (top / "x.pdf").write_bytes(b"%PDF")
    (top / "y.bin").write_bytes(b"1")
    (top / ".no.txt").write_text("x")
    (top / "own.txt").write_bytes("a\ufffdb".encode() + b"\xff")
    out = {r.path.rpartition("/")[2]: r for r in extract_directory(spark, str(top)).collect()}
    assert out["corrupt.docx"].error and out["locked.docx"].error and out["x.pdf"].error and (out["y.bin"].content, out["y.bin"].error) == ("", None)
    assert out["own.txt"].content == "a\ufffdb" and out["z.docx"].content.startswith("text text")
    assert {r.name for r in scan_directory(spark, str(top), 1).collect()} == {"z.docx", "corrupt.docx", "locked.docx", "x.pdf", "y.bin", "own.txt"}


def test_dbscan_nulls_repeats_and_copies(spark):
    schema = "id long, vec array<float>, extra string"
    rows = [(1, [0.0, 0.0], "a"), (1, [0.0, 0.0], "b"), (2, [0.0, 0.5], "a"), (3, [0.5, 0.0], "a"), (4, None, "a"), (None, [0.0, 0.0], "a"), (5, [9.0], "a"), (6, [], "a"), (7, [], "a"), (8, [], "a"), (9, [float("nan"), 0.0], "a")]
    rows += [(20 + k, [7.0, 7.0], "copy") for k in range(4)] + [(30, [7.0, 8.0], "border")]
    got = {r.id: r.cluster_no for r in dbscan(spark.createDataFrame(rows, schema), 1.0, 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 2, 21: 2, 22: 2, 23: 2, 30: 2}
    assert dbscan(spark.createDataFrame([], schema), 1.0, 3).count() == 0


@pytest.mark.parametrize(
    ("points", "least", "sizes"),
    [
        ([(0, 0), (0.1, 0), (0, 0.1)], 3, [3]),  # one cluster
        ([(0, 0), (0.1, 0), (0, 0.1), (10, 10), (10.1, 10), (10, 10.1), (50, 50)], 3, [3, 3]),  # two and noise
        ([(0, 0), (5, 5), (10, 10)], 2, []),  # noise alone
        ([(0, 0), (0.9, 0), (1.8, 0), (2.7, 0)], 2, [4]),  # a dense chain
        ([(0, 0), (1, 0), (0, 1)], 3, [3]),  # exactly eps apart
    ],
)
def test_dbscan_cases(spark, points, least, sizes):
    rows = spark.createDataFrame([(k, list(map(float, p))) for k, p in enumerate(points)], "id long, vec array<double>")
    got = {}
    for r in dbscan(rows, 1.0, least).collect():
        got.setdefault(r.cluster_no, []).append(r.id)
    assert sorted(map(len, got.values())) == sizes


@pytest.mark.parametrize(
    ("edges", "nodes", "want"),
    [
        ([(1, 2, 0.8), (2, 3, 0.7), (1, 3, 0.6)], 3, [{1, 2, 3}]),  # triangle
        ([(1, 2, 0.8), (2, 3, 0.7), (1, 3, 0.9), (4, 5, 0.8), (5, 6, 0.7), (4, 6, 0.6)], 6, [{1, 2, 3}, {4, 5, 6}]),
        ([(1, 2, 0.8), (2, 3, 0.7)], 3, [{1, 2, 3}]),  # a chain links its ends
        ([(1, 2, 0.8)], 3, []),  # too small
        ([], 3, []),
    ],
)
def test_component_cases(spark, edges, nodes, want):
    classes = spark.createDataFrame([(k, k, 1) for k in range(1, nodes + 1)], "file_id long, class_id long, class_size long")
    pairs = spark.createDataFrame([(a, b, s, 1, 1) for a, b, s in edges], "id1 long, id2 long, sim double, n1 long, n2 long")
    got = {}
    for r in clusters.class_clusters(classes, pairs).collect():
        got.setdefault(r.cluster_id, set()).add(r.class_id)
    assert sorted(got.values(), key=min) == want


def test_similar_pairs_bound_keeps_all(spark):
    """Profiles with long tails of small scores, near the threshold on both sides."""
    rnd = random.Random(9)
    rows = [(d, f"t{t}", 1.0 + 5 * rnd.random() ** 4) for d in range(60) for t in rnd.sample(range(40), 18)]
    by = {}
    for d, t, s in rows:
        by.setdefault(d, {})[t] = s
    norm = {d: sum(x * x for x in v.values()) ** 0.5 for d, v in by.items()}
    sims = {(a, b): sum(x * by[b].get(t, 0) for t, x in by[a].items()) / norm[a] / norm[b] for a in by for b in by if a < b}
    classes = similarity.profile_classes(spark.createDataFrame(rows, "file_id long, term string, score double"))
    pairs = similarity.similar_pairs(classes)
    got = {(r.id1, r.id2): r.sim for r in pairs.collect()}
    assert set(got) == {k for k, v in sims.items() if v >= 0.45} and len(got) > 50 and all(v == pytest.approx(sims[k]) for k, v in got.items())
    links = {r.file_id: r.n_links for r in similarity.file_links(classes, pairs).collect()}
    assert links == {d: sum(d in k for k in got) for d in by}


def test_move_plan_against_sequential(spark):
    rnd = random.Random(11)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "b", "b_1", ".x", "c.tar.gz"]
    rows = [(k, rnd.choice(names), rnd.randrange(3)) for k in range(80)]
    there = [("f0", "a.txt"), ("f0", "b_1"), ("f1", "a_3.txt"), ("f1", "zzz"), ("f9", "a.txt")]
    want = set()
    for s in range(3):
        taken = {n for f, n in there if f == f"f{s}"}
        for name, k in sorted((n, k) for k, n, own in rows if own == s):
            base, dot, ext = name.rpartition(".")
            base, ext = (base, dot + ext) if dot else (name, "")
            new, i = name, 0
            while new in taken:
                i += 1
                new = f"{base}_{i}{ext}"
            taken.add(new)
            want.add((s, k, new))
    files = spark.createDataFrame([(k, n) for k, n, _ in rows], "file_id long, name string")
    members = spark.createDataFrame([(s, k) for k, _, s in rows], "suggestion_id long, file_id long")
    heads = spark.createDataFrame([(s, f"f{s}") for s in range(3)], "suggestion_id long, name string")
    out = refine.move_plan(members, files, heads, spark.createDataFrame(there, "folder string, name string"))
    assert {(r.suggestion_id, r.file_id, r.new_name) for r in out.collect()} == want


def test_embedding_failures_and_cache(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts][: 1 if "short" in texts else None]

    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bb", "bad", "c", "short", "d"])], "file_id long, text string").coalesce(1)
    out = {r.file_id: (r.embedding, r.error) for r in embeddings.embed_batches(texts, embed, 2).collect()}
    assert out == {0: ([1.0], None), 1: ([2.0], None), 2: (None, "no"), 3: (None, "no"), 4: (None, "1 vectors for 2 texts"), 5: (None, "1 vectors for 2 texts")}
    cache = spark.createDataFrame([(0, "m", [9.0]), (0, "n", [8.0]), (7, "m", [7.0])], "file_id long, model string, embedding array<float>")
    new = embeddings.put_vectors(cache, spark.createDataFrame([(0, [1.0]), (2, None)], "file_id long, embedding array<float>"), "m")
    assert {(r.file_id, r.model, r.embedding[0]) for r in new.collect()} == {(0, "m", 1.0), (0, "n", 8.0), (7, "m", 7.0)}


def test_guards_known_before(spark):
    files = spark.createDataFrame([(k, p) for k, p in enumerate(["/r/a/x", "/r/b/y/z", "/r/c/w/v/u"])], "file_id long, parent_dir string")
    tree = folders.folder_tree(files, "/r")
    known = spark.createDataFrame([("/r/a", True, "m", "llm"), ("/r/a/x", True, "m", "llm"), ("/r/b", False, "m", "user"), ("/r/c", False, "m", "llm")], "path string, guarded boolean, reason string, source string")
    walked = folders.propagate_guards(tree, known, F.col("path").endswith("b") | F.col("path").endswith("/y"))
    assert {(r.path, r.guarded, r.reason) for r in walked.collect()} == {("/r/a", True, "known"), ("/r/b", False, "known"), ("/r/c", False, "classified"), ("/r/b/y", True, "classified"), ("/r/c/w", False, "classified"), ("/r/c/w/v", False, "classified"), ("/r/c/w/v/u", True, "too deep")}
    assert {r.path for r in folders.stored_guards(known, walked).collect()} == {"/r/a", "/r/b", "/r/c", "/r/b/y", "/r/c/w", "/r/c/w/v"}
    trees = folders.folder_trees(files, spark.createDataFrame([("/r",), ("/r/b/",)], "path string")).collect()
    assert {(r.root, r.path, r.parent, r.depth) for r in trees if r.root == "/r/b"} == {("/r/b", "/r/b", None, 0), ("/r/b", "/r/b/y", "/r/b", 1), ("/r/b", "/r/b/y/z", "/r/b/y", 2)}
    assert {(r.path, r.name, r.parent, r.depth, r.file_count) for r in trees if r.root == "/r"} == {tuple(r) for r in tree.select("path", "name", "parent", "depth", "file_count").collect()}


def test_folder_replies(spark):
    prompts = spark.createDataFrame([(f"/{k}", p) for k, p in enumerate(["yes", "no", "odd", "fail"])], "path string, prompt string")

    def ask(prompt):
        if prompt == "fail":
            raise OSError("gone")
        return {"yes": '{"related": true, "reason": "r"}', "no": '```json\n{"related": false}\n```', "odd": "sure!"}[prompt]

    out = {r.path: (r.guarded, r.reason) for r in refine.classify_folders(prompts, ask).collect()}
    assert out == {"/0": (True, "r"), "/1": (False, ""), "/2": (False, "reply not understood"), "/3": (False, "gone")}


def test_terms_are_counted_without_a_table_of_all_files(spark, capsys):
    """Each file's terms are counted by themselves: no aggregate is keyed by term, and rows of one id count as one file."""
    rows = [(1, "Alpha beta, ALPHA the 123 ab a1b"), (1, "beta gamma alpha"), (2, None), (3, "xKelvin zeta-zeta")]
    found = keywords.term_frequency(spark.createDataFrame(rows, "file_id long, content string"), 3)
    assert {tuple(r) for r in found.collect()} == {(1, "alpha", 3.0, 1), (1, "beta", 2.0, 2), (1, "a1b", 1.0, 3), (3, "zeta", 2.0, 1), (3, "elvin", 1.0, 2)}
    found.explain()
    assert not any("Aggregate(" in line and "term" in line for line in capsys.readouterr().out.splitlines())


def test_tasks_get_more_not_larger(spark, monkeypatch):
    """A job that says how many rows it deals has a task for each ROWS of them, and leaves the session's settings as they were."""
    monkeypatch.setattr(shared, "ROWS", 100)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(k, None) for k in keys]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).groupBy((F.col("id") * 7).alias("k")).agg(F.count("*").alias("n")).withColumn("task", F.spark_partition_id())
        tasks = [shared.cut(rows, "rows", rows=n).select("task").distinct().count() for n in (1500, 3000, 0)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks == [15, 30, 1] and [spark.conf.get(k, None) for k in keys] == before


def test_contents_are_dealt_to_more_tasks_as_there_are_more(spark, monkeypatch):
    """Counting terms takes a task for each ROWS of the terms that there may be, whoever reads them; fewer go to the session's partitions."""
    monkeypatch.setattr(shared, "ROWS", 100)
    rows = spark.createDataFrame([(i, f"word{i % 3} WORD{i % 3} other{i % 5}") for i in range(60)] + [(0, "word0"), (None, "none none")], "file_id long, content string")
    found = keywords.term_frequency(rows, 50)
    assert found.rdd.getNumPartitions() == 31 and max(found.groupBy(F.spark_partition_id()).agg(F.count("*")).toPandas().iloc[:, 1]) < 30
    assert keywords.term_frequency(rows, 50, n_files=200).rdd.getNumPartitions() == 100
    want = {(i, t, s, p) for i in range(60) for t, s, p in ((f"word{i % 3}", 2.0 + (i == 0), 1), (f"other{i % 5}", 1.0, 2))} | {(None, "none", 2.0, 1)}
    assert {tuple(r) for r in found.collect()} == want and {tuple(r) for r in keywords.term_frequency(rows, 2).collect()} == want


def test_document_frequencies_are_counted_by_more_tasks_as_there_are_more(spark, monkeypatch, tmp_path):
    """The terms of doc_frequency meet in a task for each ROWS of them; repeated ids, null texts and null ids give the same counts."""
    said, made = [], shared._small_tasks
    monkeypatch.setattr(shared, "_small_tasks", lambda rows: said.append(rows) or made(rows))
    monkeypatch.setattr(shared, "ROWS", 500)
    rows = [(i, f"word{i % 3} WORD{i % 3} other{i % 5}") for i in range(60)] + [(0, "word0 word1"), (None, "none word2"), (61, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["doc_frequency"](spark, str(tmp_path))
    assert said == [6300] and {tuple(r) for r in found.collect()} == {("word0", 20), ("word1", 21), ("word2", 21), ("none", 1)} | {(f"other{k}", 12) for k in range(5)}


def test_suggestions_rank_terms_by_tasks_for_all_entries(spark, monkeypatch):
    """The terms that name suggestions are ranked by a job that says how many entries it deals."""
    said, made = {}, suggest.cut
    monkeypatch.setattr(suggest, "cut", lambda df, name, **how: said.update({name: how}) or made(df, name, **how))
    rows = [(i, f"{i}.zzz", ".zzz", "/r", "apple banana cherry" if i < 3 else f"word{i} other{i}") for i in range(5)]
    files = spark.createDataFrame(rows, "file_id long, name string, extension string, parent_dir string, content string")
    guards = spark.createDataFrame([], "path string, guarded boolean, reason string, source string")
    found = suggest.suggest_folders(files, guards, ["/r"], min_files=2).collect()
    assert [(r.n_files, r.terms) for r in found] == [(3, "apple, banana, cherry")] and said["names"] == {"rows": 13}


def test_profiles_make_each_list_by_itself(spark, capsys, monkeypatch):
    """No window or sort holds the entries of a task's files; lists longer than n, repeated ids and many small tasks give the same rows."""
    rows = [(1, "data_one.txt", ".txt", "one two two data data DATA"), (1, "text.txt", ".txt", None), (2, None, None, None), (3, "aaa bbb aaa", "pdf", "aaa ccc ccc")]
    files = spark.createDataFrame(rows, "file_id long, name string, extension string, content string")
    entries = keywords.merged_entries(files, 3)
    assert {tuple(r) for r in entries.collect()} == {(1, "text", 5.0, 2), (1, "data", 3.0, 1), (3, "document", 5.0, 1), (3, "ccc", 2.0, 1), (3, "aaa", 1.0, 1)}
    assert {tuple(r) for r in keywords.merged_entries(files.filter("file_id = 3")).collect()} == {(3, "document", 5.0, 1), (3, "ccc", 2.0, 1), (3, "aaa", 1.0, 3), (3, "bbb", 1.0, 1)}
    entries.explain()
    assert not any(word in capsys.readouterr().out for word in ("Window", "Union"))
    monkeypatch.setattr(shared, "ROWS", 2)
    many = [(i, f"note{i % 7}.md", ".md", f"word{i % 5} word{i % 11} other") for i in range(60)]
    files = spark.createDataFrame(many, files.schema)
    made, found = keywords.profiles(keywords.merged_entries(files), files, 3)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, keywords.merged_entries(files).collect()))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, keywords.tfidf(made, files, 3).collect())) and found.count() == 180


def test_jobs_on_keywords_say_how_many_rows_they_deal(spark, monkeypatch):
    """Coherence, outliers, prompts and keywords within suggestions have tasks by their keywords or entries, with the same rows."""
    said, made = [], shared._small_tasks
    monkeypatch.setattr(shared, "_small_tasks", lambda rows: said.append(rows) or made(rows))
    monkeypatch.setattr(shared, "ROWS", 2)
    files = spark.createDataFrame([(i, f"n{i}", "/a", "aaa bbb" if i < 3 else "ccc ddd") for i in range(4)], "file_id long, name string, parent_dir string, content string")
    words = spark.createDataFrame([(i, t, 1.0, k) for i in range(4) for k, t in enumerate(("aaa", "bbb") if i < 3 else ("ccc", "ddd"), 1)], "file_id long, term string, score double, place int")
    placed = files.select("file_id", F.col("parent_dir").alias("folder"))
    found = similarity.folder_coherence(placed, words, 0.9)
    assert [(r.folder, r.n_files, round(r.coherence, 9), r.coherent) for r in found.collect()] == [("/a", 4, 0.5, False)] and said == [8]
    assert {r.file_id: round(r.mean_sim, 9) for r in similarity.folder_outliers(placed, words, found, 0.5).collect()} == {3: 0.0} and said == [8, 8]
    members = files.select(F.lit(1).alias("cluster_id"), "file_id")
    prompt = refine.cluster_prompts(members, files, words).head().prompt
    assert prompt.split("\n")[2:6] == [f"{i + 1}. n{i} (in /a): {'aaa, bbb' if i < 3 else 'ccc, ddd'}" for i in range(4)] and said == [8, 8, 8]
    own = refine.own_keywords(members.withColumnRenamed("cluster_id", "suggestion_id"), files, 1)
    assert {(r.file_id, r.term) for r in own.collect()} == {(0, "aaa"), (1, "aaa"), (2, "aaa"), (3, "ccc")} and said == [8, 8, 8, 400, 8]
