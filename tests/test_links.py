"""Clusters and scores by links and block products against all pairs."""

import random

import pytest

from foldergraph.operators import clusters, similarity
from foldergraph.operators.components import connected_components

SCORES = "file_id long, term string, score double"


def _classes(spark, seed):
    """Groups of near copies, profiles with terms in common, ones with nothing in common, and exact copies."""
    rnd = random.Random(seed)
    rows = []
    for d in range(50):
        rows += [(d, f"t{t}", rnd.choice([-0.5, 1.0, 2.0, 3.0])) for t in rnd.sample(range(14), 4)]
    for d in range(100, 130):
        rows += [(d, f"g{t}", 2.0) for t in range(6)] + [(d, f"own{d}", 1.0), (d, "t1", 0.2)]
    for d in (200, 201, 202):
        rows += [(d, "same", 1.0), (d, "t2", 1.0), (d, "none", 0.0)]
    rows += [(300, "alone", 1.0), (301, "zero", 0.0)]
    return similarity.profile_classes(spark.createDataFrame(rows, SCORES)).cache()


def _components(pairs):
    return {(r.id, r.component) for r in connected_components(pairs.selectExpr("id1 AS src", "id2 AS dst")).collect()}


@pytest.mark.parametrize(("seed", "posting", "product"), [(1, 2048, 512), (2, 5, 7)])
def test_links_and_sums_equal_those_of_all_pairs(spark, monkeypatch, seed, posting, product):
    monkeypatch.setattr(similarity, "POSTING", posting)
    monkeypatch.setattr(similarity, "PRODUCT", product)
    classes = _classes(spark, seed)
    for least in (0.45, 0.6):
        pairs = similarity.similar_pairs(classes, least)
        got = [tuple(r) for r in pairs.select("id1", "id2").collect()]
        assert len(got) == len(set(got)) > 30
        links = similarity.similar_links(classes, least)
        assert _components(links) == _components(pairs) and {tuple(r) for r in links.select("id1", "id2").collect()} <= set(got)
        found = clusters.class_clusters(classes, links, 1)
        want = {r.cluster_id: (round(r.total, 6), r.k) for r in clusters.pair_sums(found, pairs).collect()}
        sums = {r.cluster_id: (round(r.total, 6), int(r.k)) for r in similarity.profile_sums(classes, found, least).collect()}
        assert sums == want
    empty = classes.limit(0)
    assert similarity.similar_links(empty).count() == 0 and similarity.profile_sums(empty, found.limit(0)).count() == 0
    assert clusters.subclusters(classes, found, 1000).count() == found.count()


def test_near_copies_give_as_many_links_as_profiles(spark):
    n = 1500
    rows = [(d, f"g{t}", 2.0) for d in range(n) for t in range(5)] + [(d, f"own{d}", 1.0) for d in range(n)]
    classes = similarity.profile_classes(spark.createDataFrame(rows, SCORES))
    links = similarity.similar_links(classes)
    assert links.count() <= 2 * n
    found = clusters.class_clusters(classes, links)
    assert {r.n_files for r in found.collect()} == {n}
    score = clusters.cluster_scores(found, similarity.profile_sums(classes, found)).head().score
    assert score == pytest.approx(20 / 21)


@pytest.mark.parametrize("product", [2, 10, 512])
def test_sums_of_many_small_clusters(spark, monkeypatch, product):
    monkeypatch.setattr(similarity, "PRODUCT", product)  # clusters of a block share groups, others of 2 rows a block don't
    rows = [(10 * g + k, t, 1.0 + k * (t == "b")) for g in range(40) for k in range(1 + g % 5) for t in ("a", "b", f"g{g}", f"h{g}", f"i{g}")]
    classes = similarity.profile_classes(spark.createDataFrame([(d, t if t > "c" else f"{t}{d // 10}", s) for d, t, s in rows], SCORES))
    pairs = similarity.similar_pairs(classes)
    found = clusters.class_clusters(classes, pairs, 1)
    want = {r.cluster_id: (round(r.total, 6), r.k) for r in clusters.pair_sums(found, pairs).collect()}
    assert len(want) == 32
    assert {r.cluster_id: (round(r.total, 6), int(r.k)) for r in similarity.profile_sums(classes, found).collect()} == want


@pytest.mark.parametrize("posting", [8192, 200])
def test_frequent_terms_move_no_pairs(spark, monkeypatch, posting):
    """Many profiles of the same few frequent terms: what is dealt out are rows of terms, not pairs, and each pair is there once."""
    monkeypatch.setattr(similarity, "POSTING", posting)
    rnd = random.Random(3)
    rows = [(d, t, 1.0 + rnd.random()) for d in range(400) for t in rnd.sample(["und", "die", "der", "von", "ein"], 3)]
    classes = similarity.profile_classes(spark.createDataFrame(rows, SCORES)).cache()
    met = similarity._postings(classes, 0.45)
    assert met.count() <= 400 * 3 * (1 if posting > 400 else 3)
    profiles = {}
    for d, t, s in rows:
        profiles.setdefault(d, {})[t] = s
    unit = {d: {t: s / sum(x * x for x in p.values()) ** 0.5 for t, s in p.items()} for d, p in profiles.items()}
    want = {(a, b) for a in unit for b in unit if a < b and round(sum(u * unit[b].get(t, 0.0) for t, u in unit[a].items()), 9) >= 0.45}
    got = [tuple(r) for r in similarity.similar_pairs(classes).select("id1", "id2").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert similarity.similar_links(classes).count() <= met.count()


@pytest.mark.parametrize(("columns", "table", "posting"), [(126, 1 << 21, 8192), (4, 64, 8192), (6, 1, 90)])
def test_bounds_leave_few_pairs_to_measure(spark, monkeypatch, columns, table, posting):
    """Texts that share frequent words are near by dozens of terms at once: a pair is measured where its rarest one is, and hardly elsewhere."""
    for name, value in (("COLUMNS", columns), ("TABLE", table), ("POSTING", posting), ("FEW", 3), ("WIDE", 7), ("PRODUCT", 50)):
        monkeypatch.setattr(similarity, name, value)
    rnd = random.Random(8)
    common = [f"c{k}" for k in range(12)]
    rows = [(d, t, 1.0 + rnd.random()) for d in range(200) for t in rnd.sample(common, 9)]
    rows += [(d, f"r{rnd.randrange(60)}", rnd.choice([-1.0, 0.5, 3.0])) for d in range(200)] + [(d, f"only{d}", 2.0) for d in range(0, 200, 3)]
    classes = similarity.profile_classes(spark.createDataFrame(rows, SCORES).dropDuplicates(["file_id", "term"])).cache()
    unit = {r.file_id: {t: s for t, s in r.profile} for r in classes.collect()}
    unit = {d: {t: s / sum(x * x for x in p.values()) ** 0.5 for t, s in p.items()} for d, p in unit.items()}
    sims = {(a, b): sum(u * unit[b].get(t, 0.0) for t, u in unit[a].items()) for a in unit for b in unit if a < b}
    for least in (0.45, 0.8):
        pairs = similarity.similar_pairs(classes, least)
        got = {(r.id1, r.id2): r.sim for r in pairs.collect()}
        assert set(got) == {k for k, x in sims.items() if round(x, 9) >= least} and all(got[k] == pytest.approx(sims[k]) for k in got)
        assert _components(similarity.similar_links(classes, least)) == _components(pairs)
        links = {r.file_id: r.n_links for r in similarity.linked_files(classes, similarity.link_counts(classes, least)).collect()}
        assert links == {r.file_id: r.n_links for r in similarity.file_links(classes, pairs).collect()}
    groups = [similarity._Group(f, 0.45) for _, f in similarity._postings(classes, 0.45).toPandas().groupby(list(similarity._GROUP), dropna=False)]
    near = sum(x >= 0.45 for x in sims.values())
    if columns > 12:
        assert sum(len(i) for g in groups for i, _ in g.candidates()) < 1.2 * near
    assert max(g.table.size for g in groups) <= max(table, max(g.terms for g in groups) + 1)
