"""Vector codes, periodic runs and toxicity against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from foldergraph.llm import periodic, toxicity, vector_codes
from foldergraph.llm.mixing import mix, mixed_documents
from foldergraph.llm.periodic import periodic_runs, runs_of, with_echo
from foldergraph.llm.queries import op12_periodic_runs

VECTORS = "vec_id long, embedding array<float>, label int, part int, code string, n long, error long"


def _plain_codes(rows, rounds=6):
    """Row by row, entry by entry."""
    good = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max(len(v) for _, v, _ in good) // 8) * 8
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (dims - len(v)) for _, v, _ in good]
    width = dims // 8
    first = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, [np.float32(x) for x in good[k][1]]))[:16]
    near = lambda part, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(part, book[e])), e))
    books, codes = [], [[] for _ in good]
    for p in range(8):
        parts = [v[p * width : (p + 1) * width] for v in ints]
        book = [list(parts[k]) for k in first]
        for _ in range(rounds):
            own = [near(x, book) for x in parts]
            for e in range(len(book)):
                if mine := [x for x, c in zip(parts, own) if c == e]:
                    book[e] = [sum(col) // len(mine) for col in zip(*mine)]
        books.append(book)
        for k, x in enumerate(parts):
            e = near(x, book)
            codes[k].append((e, sum((a - b) ** 2 for a, b in zip(x, book[e]))))
    out = [(i, "".join(f"{e:02x}" for e, _ in c), sum(d for _, d in c), label) for (i, _, label), c in zip(good, codes)]
    totals = {}
    for _, _, d, label in out:
        totals[label] = totals.get(label, 0) + d
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((i, c, d, totals[label]) for i, c, d, label in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("leaves", [3, 4096])
def test_vector_codes(spark, monkeypatch, leaves):
    monkeypatch.setattr(vector_codes, "LEAVES", leaves)
    rnd = random.Random(3)
    rows = [(k, [rnd.choice([0.25, -0.5, rnd.random() - 0.5]) for _ in range(24)], rnd.choice([0, 1, None])) for k in range(90)]
    rows += [(k, rows[3][1], 1) for k in range(100, 140)]  # copies
    rows += [(5, rows[5][1], 0), (7, [0.1] * 24, None), (None, [0.2] * 24, 1), (200, [0.3] * 5, 2), (201, [], 2)]  # repeats, no id, short ones
    rows += [(300, None, 0), (301, [0.1, None] * 12, 0), (302, [float("nan")] * 24, 0), (303, [float("inf")] + [0.0] * 23, 0)]
    frame = spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], VECTORS).repartition(3)
    got, books = vector_codes.vector_codes(frame)
    want, digest = _plain_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=repr) == want
    assert vector_codes.books_sha256(books) == digest


def test_vector_codes_empty_and_far(spark):
    got, books = vector_codes.vector_codes(spark.createDataFrame([(1, None, 1, 1, "x", 2, 3)], VECTORS))
    assert got.count() == 0 and all(b.size == 0 for b in books)
    got, _ = vector_codes.vector_codes(spark.createDataFrame([(k, [3e38, -3e38][k % 2 :], k, 1, "x", 2, 3) for k in range(40)], VECTORS))
    assert {(r.code, r.error) for r in got.collect()} == {("0000" + "00" * 6, 0), ("0101" + "00" * 6, 0)}
    got, _ = vector_codes.vector_codes(spark.createDataFrame([(1, [], 1, 1, "x", 2, 3)], VECTORS))
    assert [tuple(r) for r in got.collect()] == [(1, 1, "00" * 8, 0, 0)]


def test_walk_equals_all_distances(monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAVES", 7)
    rnd = np.random.default_rng(1)
    for dims in (0, 1, 3, 8):
        parts, _ = vector_codes.distinct(rnd.integers(-3, 3, (500, dims)))
        book = rnd.integers(-3, 3, (16, dims))
        code, error = vector_codes.walked(parts, book)
        far = ((parts[:, None, :] - book[None]) ** 2).sum(2)
        assert (code == far.argmin(1)).all() and (error == far.min(1)).all()


def _plain_runs(w):
    """Every period by itself; a run whose words have a shorter period isn't one."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j + 1 < len(w) and w[j + 1] == w[j + 1 - q]:
                j += 1
            s, n = i - q, j - i + q + 1
            if n >= max(6, 4 * q) and not any(all(w[k] == w[k - d] for k in range(s + d, s + n)) for d in range(1, q)):
                found.append((s, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _said(rnd, most=60):
    words, n = [], rnd.randrange(most)
    while len(words) < n:
        block = [f"w{rnd.randrange(rnd.choice([1, 2, 3, 8]))}" for _ in range(rnd.randrange(1, 7))]
        words += block * rnd.randrange(1, 8) + block[: rnd.randrange(len(block))]
    return words


def test_runs_equal_every_period():
    rnd = random.Random(5)
    for _ in range(400):
        texts = [_said(rnd) for _ in range(rnd.randrange(1, 4))]
        starts = np.cumsum([0, *map(len, texts)])
        names = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        got = list(zip(*(x.tolist() for x in runs_of(np.array([names[w] for t in texts for w in t], np.int64), starts))))
        want = [(s + int(starts[k]), s + n - 1 + int(starts[k]), q) for k, t in enumerate(texts) for s, n, q in _plain_runs(t)]
        assert got == want


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr("foldergraph.llm.words.STEP", 2000)
    rnd = random.Random(6)
    rows = [(k, rnd.choice([" ", "\n", "\x0b \t"]).join(_said(rnd, 200))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "a b " * 9), (None, None), (3, rows[3][1]), (3, "x " * 40), (204, "é é " * 8), (205, "long " * 60_000), (206, "a b c d " * 20_000 + "e")]
    frame = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, n_words int, runs string, words int").repartition(3)
    want = []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        runs = _plain_runs(w) if len(w) < 5000 else [(0, len(w) - (w[-1] == "e"), 1 if w[0] == "long" else 4)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert periodic_runs(frame.limit(0)).count() == 0


def test_echo(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(k, " ".join(_said(rnd, 90))) for k in range(300)] + [(None, "a b"), (1000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in with_echo(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    full = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(full) == len(rows) and full[None].n_runs == 0 and full[1000].start is None
    changed = 0
    for i, t in rows[:300]:
        w, h = t.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
            changed += 1
        assert got[i].text.split() == w
        runs = _plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (full[i].n_runs, full[i].start, full[i].length, full[i].period) == (len(runs), *best)
        assert full[i].exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert full[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    assert changed > 10 and periodic.TIMES == 4


_MASK = (1 << 64) - 1


def _features(text):
    """The set of a text's features, word by word."""
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = [xxhash.xxh64_intdigest(re.sub(r"^\W+|\W+$", "", w).lower() or w) * 0x9E3779B97F4A7C15 & _MASK for w in words]
    found = {x >> 32 for x in h}
    for gap in toxicity.GAPS:
        found |= {((a ^ (b * 0xD6E8FEB86659FD93 + gap & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK) >> 32 for a, b in zip(h, h[gap:])}
    return found


def test_features_equal_word_by_word():
    texts = ["You idiot, YOU!", None, "", " \n", "### $$ a", "one", "eins zwei drei vier fünf\x0bsechs", "a " * 50]
    got = [set() for _ in texts]
    for f, row in toxicity.hashed(pa.array(texts)):
        for x, r in zip(f.tolist(), row.tolist()):
            got[r].add(x)
    assert got == [_features(t) for t in texts]


def test_ftrl_equals_coordinate_by_coordinate():
    rnd = random.Random(8)
    rows = [(rnd.randrange(2), np.array(sorted(rnd.sample(range(12), rnd.randrange(1, 6))))) for _ in range(80)]
    least = np.r_[np.full(11, 0.7), 0.0]
    z, n = np.zeros(12), np.zeros(12)
    for _ in range(3):
        toxicity.went_through(rows, z, n, least, -1.0)
    zs, ns = [0.0] * 12, [0.0] * 12

    def weight(k):
        return 0.0 if abs(zs[k]) <= least[k] else (math.copysign(least[k], zs[k]) - zs[k]) / ((toxicity.BETA + math.sqrt(ns[k])) / toxicity.ALPHA)

    for y, at in rows * 3:
        w = {k: weight(k) for k in at.tolist()}
        slope = 1 / (1 + math.exp(1.0 - sum(w.values()))) - y
        for k in w:
            zs[k] += slope - (math.sqrt(ns[k] + slope**2) - math.sqrt(ns[k])) / toxicity.ALPHA * w[k]
            ns[k] += slope**2
    assert np.allclose(z, zs) and np.allclose(n, ns)
    assert np.allclose(toxicity.weights(z, n, least), [weight(k) for k in range(12)]) and 0 < (toxicity.weights(z, n, least) == 0).sum() < 12


LABELLED = "doc_id long, text string, toxic int, score int, held_out string, y int, at int"


@pytest.mark.parametrize("shard_rows", [100, 4096])
def test_toxicity(spark, monkeypatch, shard_rows):
    """Held-out texts with the words that make a text toxic are found, others are left alone."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", shard_rows)
    rnd = random.Random(9)
    vile, words = ["skrell", "vurg", "mopf"], [f"w{k}" for k in range(60)]
    rows = []
    for k in range(500):
        said, toxic = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))], k % 5 == 0
        for _ in range(rnd.randrange(2, 5) * toxic):
            said[rnd.randrange(len(said))] = rnd.choice(vile).upper() + ","
        rows.append((k, " ".join(said), int(toxic)))
    odd = [(600, None), (601, ""), (None, "skrell vurg mopf"), (602, "w1 " * 30_000 + "skrell vurg mopf"), (603, "w1 " * 30_000), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, 9, 9, "x", 9, 9) for i, t, *_ in rows + odd], LABELLED).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (None, 1), (9999, 1), (600, 0), (10, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in by if i is not None) and not by[None].held_out
    held = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert len(held) > 60 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert by[None].predicted == 1 and by[602].predicted == 1 and by[603].predicted == 0
    assert by[600].score == by[601].score < 0.5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len(model.features) < 60 and (np.diff(model.features.astype(np.int64)) > 0).all()
    again = toxicity.fit(docs.repartition(2), labels.repartition(4))
    assert (again.features == model.features).all() and (again.weights == model.weights).all()


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    docs = spark.createDataFrame([(k, "skrell " * (k % 2 + 1), 0, 0, "x", 0, 0) for k in ids], LABELLED)
    labels = spark.createDataFrame([(k, 1) for k in ids], "doc_id long, toxic int")
    for told in (labels, labels.limit(0)):
        model = toxicity.fit(docs, told)
        assert len(model.features) == 0 and {r.predicted for r in toxicity.toxicity(docs, model).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_frequent_features_and_sample(spark):
    rows = [np.array(x, "<u4").tobytes() for x in ([1, 2, 3], [2, 3], [3, 4_000_000_000], [4_000_000_000, 2], [4_000_000_000])]
    frame = spark.createDataFrame([(k, 0, bytearray(x)) for k, x in enumerate(rows)], "at long, y int, features binary")
    assert toxicity.frequent(frame, 2).tolist() == [2, 3, 4_000_000_000] and toxicity.frequent(frame, 1, 3).tolist() == [2, 3, 4_000_000_000] and toxicity.frequent(frame, 2, 2).tolist() == []
    docs = spark.createDataFrame([(k, f"w{k}", 0, 0, "x", 0, 0) for k in range(300)], LABELLED)
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, 20).count() == 20


def test_repeated_rows_of_a_mix(spark):
    """Rows alike in doc_id, text and source but not in the rest: which are taken doesn't depend on how the table is split."""
    rows = [(7, "a b c", "s", k) for k in range(9)] + [(k, f"w{k} " * 3, "s" if k % 2 else "t", 0) for k in range(20, 60)] + [(None, None, None, 1), (None, "", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    taken = [sorted(map(repr, mixed_documents(docs.repartition(k)).collect())) for k in (1, 5)]
    assert taken[0] == taken[1] and mixed_documents(docs).columns == docs.columns
    want = {(r.doc_id, r.source): 0 for r in mix(docs).collect()}
    for r in mix(docs).collect():
        want[r.doc_id, r.source] += r.times
    got = dict.fromkeys(want, 0)
    for r in mixed_documents(docs).collect():
        got[r.doc_id, r.source] += 1
    assert got == want
    own = [r.row for r in mixed_documents(docs).collect() if r.doc_id == 7]
    assert len(own) > 0 and max(own.count(k) for k in range(9)) - min(own.count(k) for k in range(9)) <= 1
    assert mixed_documents(docs.limit(0)).count() == 0
