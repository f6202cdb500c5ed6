import collections
import hashlib
import io
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from foldergraph.llm import piece_nbest, quality, simhash, suffix_dedup, token_shards, warc
from foldergraph.llm.common import text_key
from foldergraph.llm.exact_dedup import exact_dedup
from foldergraph.llm.line_dedup import line_dedup
from foldergraph.llm.mixing import mix, mixed_documents, source_targets
from foldergraph.llm.preference import formatted, preference_pairs

# extra columns with names that operators use inside
DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, at int, size long, row string, text_key long, _salt int, bin int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 1, 2, "r", 3, 4, 5) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "théta"]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = said(20)
    out = [(k, said(rnd.randrange(1, 120)) + "\n" + (shared if k % 3 == 0 else said(4)) + "\nl1\nl2\nl3", ["en", "de", None][k % 3], ["a", "b", None, "c"][k % 4]) for k in range(40)]
    out += [(100, out[5][1], "en", "a"), (101, out[5][1].replace(" ", "  "), "en", "a"), (102, None, "en", "a"), (103, "", None, None), (104, " \n", "de", "b"), (None, out[7][1], "en", "a"), (None, "only here", "en", "b")]
    out += [out[3], (105, "long " * 30_000, "en", "b"), (106, "long " * 30_000 + "end", "en", "b"), (107, "aaaa" * 60, "en", "c"), (108, "aaaa" * 70, "en", "c")]
    return out


def test_exact_dedup(spark, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in rows:
        g = groups[norm(t)]
        want.append((i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    got = exact_dedup(_docs(spark, rows), block_chars=64).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)
    assert sum(r.kept for r in got) == len(groups)


def test_line_dedup(spark, rows):
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    first = {}
    for i, t, *_ in docs:
        lines = (t or "").split("\n")
        for k in range(len(lines) - 2):
            first.setdefault(tuple(lines[k : k + 3]), -1 if i is None else i)
    want = set()
    for i, t, *_ in docs:
        lines, own, gone = (t or "").split("\n"), set(), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if first[w] < (-1 if i is None else i) or w in own:
                gone |= {k, k + 1, k + 2}
            own.add(w)
        want.add((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    out = line_dedup(_docs(spark, rows))
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()} == want and out.count() == len(rows)


def test_suffix_dedup(spark, rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    key = lambda i: -(2**63) if i is None else i
    for i, t in texts:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], 2**63), key(i))
    want = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < key(i):
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.suffix_dedup(_docs(spark, rows)).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got)


def test_hot_keys_and_suffix_array(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    passage = "the same passage of more than fifty bytes, in every document of all"
    docs = _docs(spark, [(k, f"{k * 7919} {passage} {k * 104729}", "en", "a") for k in range(12)])
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[0] == 0 and all(got[k] >= len(passage) for k in range(1, 12))
    raw = bytes(random.Random(4).choices([1, 2, 3], k=300)) + b"\x00"
    wanted = np.zeros(len(raw), bool)
    wanted[:250] = True
    order = [int(p) for p in suffix_dedup.suffix_array(raw, wanted) if wanted[p]]
    assert sorted(order) == list(range(250)) and [raw[p : p + 50] for p in order] == sorted(raw[p : p + 50] for p in range(250))
    assert suffix_dedup.common_prefix(raw, np.array([0, 0]), np.array([0, 300])).tolist() == [50, 0]


def test_mixing(spark, rows):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    # 5, 2, 1, 5: a and c stop at 300 and 30; b and null share 1280 by 2 and 5
    assert got["a"] == 300 and got["c"] == 30 and got["b"] == pytest.approx(1280 * 2 / 7) and got[None] == pytest.approx(1280 * 5 / 7)
    docs = _docs(spark, rows)
    out = mix(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in out)
    for s in ("a", "b", "c", None):
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sorted(map(repr, out)) == sorted(map(repr, mix(docs.repartition(7)).collect()))
    made = mixed_documents(docs)
    assert made.columns == docs.columns and made.count() == sum(r.times for r in out)
    key = lambda r: (repr(r.doc_id), r.text_key)
    want = collections.Counter()
    for r in out:
        want[key(r)] += r.times
    assert collections.Counter(map(key, made.select("doc_id", text_key().alias("text_key")).collect())) == +want


def test_mixing_of_repeated_rows_and_markup(spark):
    # repeated rows of which some fit: each row of the mix is one document
    docs = _docs(spark, [(1, "one two three", "en", "a")] * 5 + [(2, "w " * 40, "en", "b"), (3, "v " * 30, "en", "b")])
    out = mix(docs).collect()
    assert mixed_documents(docs).groupBy("doc_id").count().orderBy("doc_id").collect() == [(k, n) for k in (1, 2, 3) if (n := sum(r.times for r in out if r.doc_id == k))]
    # a source of markup: keys are large, but no range of the order holds much more than its share
    docs = _docs(spark, [(k, "<b>" * 20 + str(k), "en", "html") for k in range(4000)])
    before = {r.doc_id: (r.target, r.taken) for r in mix(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert {r.doc_id: (r.target, r.taken) for r in mix(docs).collect()} == before  # whatever the number of ranges
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_token_shards(spark, rows, tmp_path):
    assert sorted(token_shards.feistel(np.arange(1000), 1000).tolist()) == list(range(1000))
    texts = [t or "" for _, t, *_ in rows] + ["a  b\n \n c　 x", " x", "\u0085 y", "it's 12 é"]
    model = token_shards.encoding(token_shards.VOCABULARY)
    alone = [model.encode_ordinary(t) for t in texts]
    assert [token_shards.encoded([t]).tolist() for t in texts] == alone
    assert token_shards.encoded(texts, end=[7, 8]).tolist() == [i for x in alone for i in (*x, 7, 8)] and len(token_shards.encoded([])) == 0
    docs, key = _docs(spark, rows), lambda r: (r.doc_id is not None, r.doc_id or 0, r.key)
    texts = [r.text or "" for r in sorted(docs.select("doc_id", text_key().alias("key"), "text").collect(), key=key)]
    want = np.concatenate([[*model.encode_ordinary(t), token_shards.END] for t in texts]).tolist()
    found = []
    for splits, secret in ((1, 5), (3, 5), (8, 5), (8, 6)):  # two keys into one folder
        out = token_shards.token_shards(docs.repartition(splits, "text"), str(tmp_path / f"s{min(splits, 7)}"), length=32, shard_bytes=1024, key=secret).orderBy("slot").collect()
        assert [r.slot for r in out] == list(range(len(out))) and [(r.shard, r.offset) for r in out] == [(k // 16, k % 16 * 64) for k in range(len(out))]
        data = [token_shards.read_slots(r.path, r.offset, 32)[0] for r in out]
        assert [zlib.crc32(x.tobytes()) for x in data] == [r.crc32 for r in out]
        slot = token_shards.feistel(np.arange(len(out)), len(out), secret).tolist()
        assert [int(t) for k in slot for t in data[k][: out[k].n_tokens]] == want and all((data[r.slot][r.n_tokens :] == token_shards.END).all() for r in out)
        found.append([r.crc32 for r in out])
    assert found[0] == found[1] == found[2] != found[3]
    assert token_shards.token_shards(docs.limit(0)).count() == 0


def _perplexities(texts):
    """Log perplexity of each text by the definition: modified Kneser-Ney over pairs of words, one occurrence of the pair left out."""
    edge = quality.EDGE
    rows = [[edge, *(quality.word_class(w.lower()) for w in t.encode().split()), edge] for t in texts]
    pairs = collections.Counter(x for r in rows if len(r) > 2 for x in zip(r, r[1:]))

    def cuts(counts):
        t = [0, *(float(sum(v == c for v in counts)) for c in (1, 2, 3, 4))]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        found = [c - (c + 1) * y * t[c + 1] / t[c] if t[c] else 0.0 for c in (1, 2, 3)]
        return [0.0, *(d if 0 < d <= c else c / 2 for c, d in zip((1, 2, 3), found))]

    d2, d1 = cuts(pairs.values()), cuts(collections.Counter(w for _, w in pairs).values())
    ends = collections.Counter(w for _, w in pairs)

    def prob(c, w):
        """From the counts without one occurrence of the pair (c, w)."""
        less = pairs - collections.Counter([(c, w)])
        own = collections.Counter(ends) - collections.Counter([w] * ((c, w) not in less))
        total = sum(own.values())
        low = (own[w] - d1[min(own[w], 3)] + sum(d1[min(v, 3)] for v in own.values()) / quality.CLASSES) / total if total else 1 / quality.CLASSES
        of = [v for (x, _), v in less.items() if x == c]
        return (less[c, w] - d2[min(less[c, w], 3)] + sum(d2[min(v, 3)] for v in of) * low) / sum(of) if of else low

    known = {x: math.log(prob(*x)) for x in pairs}
    return [-sum(known[x] for x in zip(r, r[1:])) / (len(r) - 1) if len(r) > 2 else None for r in rows]


def _counted(text):
    """The counts of the rules by their definition."""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), (text or "").split("\n")
    full = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    times = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if times[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(lines[k] in lines[:k] for k in full), len(covered)


@pytest.mark.parametrize(("bucket_words", "chunk_words"), [(1 << 22, 3 << 20), (500, 300)])
def test_quality_against_brute_force(spark, rows, monkeypatch, bucket_words, chunk_words):
    monkeypatch.setattr(quality, "BUCKET_WORDS", bucket_words)  # several buckets and chunks
    monkeypatch.setattr(quality, "CHUNK_WORDS", chunk_words)
    rows = [r for r in rows if r[0] not in (105, 106)] + [(200, "a b\n\n#c d\na b\n a b\n#c d | <x>\u00a0y\u2003z\r\nq", "en", "a"), (201, "lone", "xx", "a"), (202, "Alpha BETA " * 30, "en", "b")]
    want = []
    for lang in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lang]
        want += [(i, lang or "", *_counted(t), p) for (i, t, *_), p in zip(own, _perplexities([r[1] or "" for r in own]))]
    got = quality.quality_rules(_docs(spark, rows)).collect()
    order = lambda x: (repr(x[0]), *x[1:-1], x[-1] or 0.0)
    found = [(r.doc_id, r.lang, *(r[c] for c in quality.COUNTS), r.log_perplexity) for r in got]
    for a, b in zip(sorted(want, key=order), sorted(found, key=order), strict=True):
        assert a[:-1] == b[:-1] and a[-1] == (None if a[-1] is None else pytest.approx(b[-1], abs=1e-9))
    bands = {}
    for lang in {r.lang for r in got}:
        bins = sorted(round(r.log_perplexity / quality.GRAIN) for r in got if r.lang == lang and not r.base_failed)
        if bins:
            mid = bins[(len(bins) - 1) // 2]
            off = sorted(abs(x - mid) for x in bins)[(len(bins) - 1) // 2]
            bands[lang] = mid * quality.GRAIN, max(off, 10) * quality.GRAIN * 1.4826
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        mid, spread = bands.get(r.lang, (0.0, 0.0))
        assert r.kept == (not r.base_failed and mid - quality.LOWER * spread <= r.log_perplexity <= mid + quality.UPPER * spread)


def test_quality(spark, rows):
    assert quality.counted(None) == (0, 0, 0, 0, 0) == _counted(None)
    assert quality.counted("a b c a b c\na b\n\nx #\nx #") == (12, 12, 2, 1, 8)  # abc, bca and cab occur twice and cover the first eight words
    values = np.array([0, 1, 255, 256, 2**43, 5], np.int64)
    assert quality.unpacked(quality.packed(values)).tolist() == values.tolist() and len(quality.unpacked(quality.packed(values[:0]))) == 0
    pair = np.array([0, 1, quality.PAIRS - 1, 12345678901], np.uint64)
    first, second = quality.split_pair((pair * np.uint64(quality.MIX)) & np.uint64(quality.PAIRS - 1))
    assert ((first.astype(np.uint64) << np.uint64(quality.CLASS_BITS)) | second.astype(np.uint64)).tolist() == pair.tolist()
    # of a context, the probabilities of all classes sum to one (nothing left out)
    rnd = np.random.default_rng(1)
    first, second = rnd.integers(1, 9, 400), rnd.integers(1, 30, 400)
    found, n = np.unique(np.stack([first, second]), axis=1, return_counts=True)
    tables = np.zeros((quality.TABLES, quality.CLASSES), np.int64)
    for k, own in enumerate((n, n == 1, n == 2, n > 2)):
        np.add.at(tables[k], found[0], own)
    np.add.at(tables[4], found[1], 1)
    model = quality.PairModel(((k, tables[:, k * quality.RANGE : (k + 1) * quality.RANGE]) for k in range(quality.CLASSES // quality.RANGE)), np.array([(n == k).sum() for k in (1, 2, 3, 4)]))
    d = model.d2[np.minimum(n, 3)]
    for c in range(1, 9):
        own = found[0] == c
        assert (n[own] - d[own]).sum() + model.left[c] == pytest.approx(model.total[c])
    low = model.after - model.d1[np.minimum(model.after, 3)]
    assert (low.sum() + model.rest) / model.pairs == pytest.approx(1.0)
    got = quality.quality_rules(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and not any(r.kept and r.base_failed for r in got)
    assert [r.base_failed for r in got if r.doc_id in (102, 103, 105)] == [True] * 3
    kept = quality.quality_filter(_docs(spark, rows))
    assert "lang" in kept.columns and kept.count() == sum(r.kept for r in got)


def _print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, rows, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 3)
    prints = {t: _print(t) for _, t, *_ in rows}
    assert all(simhash.fingerprint(t) == p for t, p in prints.items())
    rnd = random.Random(6)
    words = np.array([rnd.getrandbits(64) for _ in range(30)] + [0, 1, 3, 7, 15], np.uint64)
    words = np.unique(np.r_[words, words[:20] ^ np.uint64(1 << 40), words[:10] ^ np.uint64(0b1011 << 7)])
    pairs = {tuple(sorted((int(a), int(b)))) for x, y in simhash.GrayIndex(words, np.zeros(len(words), np.int64), 3).pairs() for a, b in zip(x, y)}
    assert pairs == {(a, b) for a, b in itertools.combinations(range(len(words)), 2) if int(words[a] ^ words[b]).bit_count() <= 3}
    got = simhash.simhash_groups(_docs(spark, rows)).collect()
    n = len(rows)
    root = list(range(n))
    for a, b in itertools.combinations(range(n), 2):
        if (prints[rows[a][1]] ^ prints[rows[b][1]]).bit_count() <= 3:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
    want = [(rows[k][0], prints[rows[k][1]], min((rows[j][0] for j in range(n) if root[j] == root[k] and rows[j][0] is not None), default=None)) for k in range(n)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.fp % 2**64, r.component_id)) for r in got)


def test_pieces(spark, rows):
    model = piece_nbest.pieces(piece_nbest.MODEL)

    def ways(unit, at=0):
        if at == len(unit):
            yield 0.0, ()
        for end in range(at + 1, min(len(unit), at + model.longest) + 1):
            i = model.ids.get(unit[at:end], -1)
            if i >= 0 or end == at + 1:
                for score, rest in ways(unit, end):
                    yield score + (model.scores[i] if i >= 0 else model.unknown), (i, *rest)

    units = [" the", " thing.", " 漢\U0001f600x", " ▁a", " ", "   b", " \n"]
    for unit, (ids, score, gap) in zip(units, model.best(units)):
        every = sorted((s for s, _ in ways(unit)), reverse=True)
        assert [s for s, _ in model.nbest(unit, 4)] == pytest.approx(every[:4]) and score == pytest.approx(every[0])
        assert gap == pytest.approx(every[0] - every[1]) if len(every) > 1 else gap == np.inf
        assert model.decoded(np.frombuffer(ids, piece_nbest.IDS)) == unit[1:]
    # long units: ties without end, and characters in no order
    rnd = random.Random(12)
    for unit in (" " + "a" * 3000, " " + "".join(rnd.choices("abcdefgh+/XYZ012é", k=3000))):
        (ids, score, gap), found = model.best([unit])[0], model.nbest(unit, 4)
        assert model.best_two(unit) == (ids, pytest.approx(score), pytest.approx(gap, abs=1e-6)) and len({x for _, x in found}) == 4
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and all(model.decoded(np.frombuffer(x, piece_nbest.IDS)) == unit[1:] for _, x in found)
    word = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=1_000_000))
    began = time.monotonic()
    assert piece_nbest.Encoder(piece_nbest.MODEL, 4).encoded(np.arange(0)) and len(model.nbest(" " + word, 4)) == 4 and time.monotonic() - began < 60
    # pieces come from the vocabulary's library, so that both decode each other's ids, and no more ids are needed
    library = sentencepiece.SentencePieceProcessor(model_file=piece_nbest.MODEL)
    several = [t or "" for _, t, *_ in rows]
    encoder = piece_nbest.Encoder(piece_nbest.MODEL, 4)
    own = [np.frombuffer(encoder.encoded(u)[0], piece_nbest.IDS).tolist() for u in encoder.parted(several)]
    assert all(library.decode(x) == t for x, t in zip(own, several)) and sum(map(len, own)) <= 1.03 * sum(map(len, library.encode(several)))
    text = "a thing of"
    encoder = piece_nbest.Encoder(piece_nbest.MODEL, 4)
    data, best, same = encoder.encoded(encoder.parted([text])[0])
    every = sorted((sum(x[0] for x in c) for c in itertools.product(*[list(ways(u)) for u in (" a", " thing", " of")])), reverse=True)
    assert [x["score"] for x in best] == pytest.approx(every[:4]) and same
    out = piece_nbest.encode(_docs(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    back = piece_nbest.decode(piece_nbest.encode(_docs(spark, rows)))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, *_ in rows)


def _preferences(turns):
    """(conv_id, donor_id, n_common, prompt, chosen, rejected) by the definition; turns without a conv_id are conversations."""
    talks = {}
    for c, turn, role, text in turns:
        talks.setdefault((c,) if c is not None else (None, turn, role, text), []).append((turn, role or "", text or ""))
    talks = [(k[0], [x[1:] for x in sorted(v, key=lambda x: ((x[0] is not None, x[0] or 0), *x[1:]))]) for k, v in talks.items()]
    at = [max((k for k, (role, _) in enumerate(v) if k and role == "assistant"), default=len(v) - 1) for _, v in talks]
    name = lambda x: hashlib.md5(f"{x[0]}\n{x[1]}".encode()).hexdigest()
    answers = {}
    for (c, v), k in zip(talks, at):
        answers.setdefault(name(v[k]), (v[k], []))[1].append(c)
    order = sorted(answers)
    said = lambda v: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in v)
    for (c, v), k in zip(talks, at):
        if len(order) == 1:
            yield c, None, 0, "", said(v), None
            continue
        donor, ids = answers[order[(order.index(name(v[k])) + 1) % len(order)]]
        other = [*v[:k], donor, *v[k + 1 :]]
        yield c, min((x for x in ids if x is not None), default=None), k, said(v[:k]), said(v[k:]), said(other[k:])


def test_preference(spark):
    schema = "conv_id long, turn long, role string, text string, key string, rank int, answer string"
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "long answer"), (2, 0, "user", "q"), (2, 1, "assistant", "yes"), (2, 2, "user", "thanks"), (3, 0, None, None), (4, 0, "user", "a"), (4, 1, "user", "b")]
    turns += [(5, 0, "system", "s"), (5, 1, "user", "u" * 100_000), (5, 2, "assistant", "long answer"), (5, 2, "assistant", "long answer"), (6, 1, "assistant", "first"), (6, 2, "user", "q"), (None, 0, "user", "q"), (None, 0, "user", "lone"), (7, None, "user", "x"), (7, 0, "assistant", "y")]
    docs = spark.createDataFrame([(*t, "k", 1, "a") for t in turns], schema)
    got = preference_pairs(docs).collect()
    assert sorted(map(repr, _preferences(turns))) == sorted(repr((r.conv_id, r.donor_id, r.n_common, r.prompt, r.chosen, r.rejected)) for r in got)
    for r in got:
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            own = [text[int(a) : int(b)] for a, b in (x.split(":") for x in spans.split(",") if x)]
            assert own == [f"{x}<|end|>\n" for x in re.findall(r"<\|assistant\|>\n(.*?)<\|end\|>\n", text, re.S)]
    one = preference_pairs(docs.filter("conv_id = 1")).collect()
    assert [(r.n_common, r.prompt, r.rejected, r.rejected_spans) for r in one] == [(0, "", None, None)] and one[0].chosen.startswith("<|user|>\nq")
    assert preference_pairs(docs.limit(0)).count() == 0
    # the operator takes any two conversations; the common prefix may be all of one
    c, r = [("user", "q"), ("assistant", "a"), ("user", "more")], [("user", "q"), ("assistant", "a")]
    out = formatted(spark.createDataFrame([(9, c, r)], "pair_id int, c array<struct<role string, text string>>, r array<struct<role string, text string>>")).head()
    assert (out.n_common, out.chosen, out.rejected) == (2, "<|user|>\nmore<|end|>\n", "")


def test_warc(spark, tmp_path):
    big = "xé" * 700
    pages = [(1, "http://a/%0A?\n", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "n", big)]
    out = {r.page_id: r for r in warc.warc_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 3)}
    assert all(r.verified for r in out.values()) and out[1].url == "http://a/%0A?\n" and out[2].url is None
    assert bytes(out[3].payload) == big.encode() and out[1].payload_bytes == len(big.encode()) and out[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    # repeated rows and ids, extra columns, a payload of many chunks
    rnd = random.Random(3)
    long = "".join(rnd.choices("abcdefgh<>/ é", k=300_000))
    again = [(1, "u", big), (1, "u", big), (2, "u", long), (3, "u", long), (2, "u", "else" * 300)]
    out = warc.warc_round_trip(spark.createDataFrame([(*p, "x", 7) for p in again], "page_id long, url string, html string, digest string, size int")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in out) == sorted([(1, "response", 0, len(big.encode())), (1, "response", 0, len(big.encode())), (2, "revisit", 3, len(long.encode())), (3, "response", 0, len(long.encode())), (2, "response", 0, 1200)])
    assert all(r.verified for r in out) and any(r.payload and bytes(r.payload) == long.encode() for r in out)
    # a payload that was changed, and a revisit whose response isn't there, are not verified; wrong framing is an error
    digest = hashlib.sha1(b"payload").hexdigest()
    good = warc.record(1, "u", b"payload", digest, 7, None)
    assert warc.parsed(next(warc.members(io.BytesIO(good))))["verified"]
    bad = warc.parsed(next(warc.members(io.BytesIO(warc.record(1, "u", b"changed", digest, 7, None)))))
    assert not bad["verified"] and bad["payload_digest"] == hashlib.sha1(b"changed").hexdigest()
    raw = zlib.decompress(good, 31)
    with pytest.raises(ValueError, match="as long as it says"):
        warc.parsed(raw[:-8] + raw[-4:])
    (tmp_path / "w").mkdir()
    for name, parts in (("a", [good]), ("b", [warc.record(2, None, b"", digest, 7, 1), warc.record(3, None, b"", digest, 7, 9)])):
        (tmp_path / "w" / name).write_bytes(b"".join(parts))
    manifest = spark.createDataFrame([(str(tmp_path / "w" / x), 1, 1) for x in "ab"], warc.MANIFEST)
    assert {r.page_id: r.verified for r in warc.checked_revisits(warc.read_archives(manifest, payload=False)).collect()} == {1: True, 2: True, 3: False}
    data = warc.record(1, "u", b"p", hashlib.sha1(b"p").hexdigest(), 1, None)

    class Slow:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out

    assert len(list(warc.members(Slow(data * 3)))) == 3
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(Slow(data[:-9])))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for run in (exact_dedup, line_dedup, suffix_dedup.suffix_dedup, mix, quality.quality_rules, simhash.simhash_groups, piece_nbest.encode, mixed_documents, simhash.simhash_dedup, quality.quality_filter):
        assert run(empty).count() == 0
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, rows, tmp_path):
    """Every stage's rows against its brute-force version over what the stage before left, and run()'s rows against the last one's."""
    import corpus_pipeline

    rnd = random.Random(21)
    words = [f"word{k}" for k in range(60)]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [said(90) + "\n" + said(8) + "\nx1\nx2\nx3\n" + said(6) for _ in range(14)]
    docs = [(k, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3]) for k, t in enumerate(base)]
    docs += [(50 + k, t.replace("x1", said(1)), docs[k][2], "b") for k, t in enumerate(base[:6])] + [(70 + k, base[k], docs[k][2], "a") for k in range(3)]
    docs += [(90, None, "en", "a"), (91, "", None, None), (None, said(80), "en", "a"), docs[2], (92, "###$$$ " * 70, "en", "b")]
    table = _docs(spark, docs).withColumn("n_lines", F.lit(-5))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    columns, now = table.columns, table
    key = lambda i: (i is not None, i or 0)
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.lang, r.source) for r in now.collect()]
        now = stage(spark, now, str(tmp_path))
        if name != "pieces":
            assert now.columns == columns and {r.n_lines for r in now.collect()} <= {-5}
            after = sorted(repr((r.doc_id, r.text)) for r in now.collect())
        if name == "quality rules":
            want = []
            for lang in {r[2] for r in before}:
                own = [r for r in before if r[2] == lang]
                good = [n >= 50 and 100 * rep <= 50 * n for n, _, _, _, rep in map(_counted, (r[1] for r in own))]
                scores = _perplexities([r[1] or "" for r in own])
                bins = sorted(round(s / quality.GRAIN) for s, g in zip(scores, good) if g)
                if bins:
                    mid = bins[(len(bins) - 1) // 2]
                    spread = max(sorted(abs(x - mid) for x in bins)[(len(bins) - 1) // 2], 10) * 1.4826
                    want += [r[:2] for r, s, g in zip(own, scores, good) if g and mid - quality.LOWER * spread <= s / quality.GRAIN <= mid + quality.UPPER * spread]
            assert after == sorted(map(repr, want)) and 10 < len(want) < len(before)
        elif name == "line dedup":
            first, want = {}, []
            for i, t, *_ in sorted(set(before), key=lambda r: (key(r[0]), r[1])):
                lines = t.split("\n")
                for k in range(len(lines) - 2):
                    first.setdefault(tuple(lines[k : k + 3]), (key(i), k))
            for i, t, *_ in before:
                lines = t.split("\n")
                gone = {j for k in range(len(lines) - 2) if first[tuple(lines[k : k + 3])] < (key(i), k) and first[tuple(lines[k : k + 3])] != (key(i), k) for j in (k, k + 1, k + 2)}
                text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
                want += [(i, text)] * bool(text)
            assert after == sorted(map(repr, want)) and want != [r[:2] for r in before]
        elif name == "near duplicates":
            want = [r[:2] for r, w in zip(before, _near_groups(before)) if r[0] == w]
            assert after == sorted(map(repr, want))
        elif name == "mixing":
            taken = [r.times for r in mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string")).collect()]
            sizes = collections.Counter()
            for r in before:
                sizes[r[3]] += len(r[1].split())
            got = collections.Counter()
            for r in now.collect():
                got[r.source] += len(r.text.split())
            order = sorted(sizes, key=lambda x: (x is None, x or ""))
            weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}
            target, full = {}, set()
            while True:
                left = sum(sizes.values()) - sum(3 * sizes[x] for x in full)
                target = {x: 3 * sizes[x] if x in full else left * weight[x] / sum(weight[y] for y in order if y not in full) for x in order}
                if not (over := {x for x in order if x not in full and target[x] > 3 * sizes[x]}):
                    break
                full |= over
            assert all(abs(got[x] - target[x]) <= max(len(r[1].split()) for r in before if r[3] == x) for x in order)
            assert sum(taken) == now.count() and set(after) <= {repr(r[:2]) for r in before}
        else:
            model = piece_nbest.Encoder(piece_nbest.MODEL, piece_nbest.NBEST)
            want = sorted(repr((i, model.encoded(model.parted([t])[0])[0])) for i, t, *_ in before)
            assert now.columns == ["doc_id", "ids", "nbest", "round_trip"] and want == sorted(repr((r.doc_id, bytes(r.ids))) for r in now.collect())
            assert want == sorted(repr((r["doc_id"], bytes(r["ids"]))) for r in kept) and all(r["round_trip"] for r in kept)


def test_stages_of_empty_tables(spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, _docs(spark, []), "").count() == 0


def _near_groups(rows):
    """For each row the smallest doc_id that it is connected to over pairs of 5-word Jaccard similarity 0.8 or more."""
    sets = []
    for _, t, *_ in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if (not sets[a] and not sets[b]) or both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
    return [min((rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None), default=None) for k in range(len(rows))]


@pytest.fixture(scope="module")
def near_rows(rows):
    """rows, and groups of copies with words changed, chains among them: similarities on both sides of 0.8."""
    rnd, out = random.Random(8), list(rows)
    words = [f"w{k}" for k in range(400)]
    for group in range(6):
        base = [rnd.choice(words) for _ in range(100)]
        for k in range(8):
            if k % 3 == 2:
                base = own
            own = list(base)
            for at in rnd.sample(range(100), k % 5):
                own[at] = rnd.choice(words)
            out.append((1000 + 10 * group + (7 * k) % 8, " ".join(own), "en", "a"))
    return out


@pytest.mark.parametrize("part_rows", [4, 1 << 17])
def test_near_dedup(spark, near_rows, monkeypatch, part_rows):
    monkeypatch.setattr(simhash, "PART_ROWS", part_rows)  # parts dealt to pairs of blocks
    want = _near_groups(near_rows)
    got = simhash.near_groups(_docs(spark, near_rows)).collect()
    assert sorted(repr((i, w)) for (i, *_), w in zip(near_rows, want)) == sorted(repr((r.doc_id, r.component_id)) for r in got)
    assert 1 < len({w for w in want if w and w >= 1000}) < 48


def test_near_duplicate_stage(spark, near_rows):
    import corpus_pipeline

    want = [(i, t) for (i, t, *_), w in zip(near_rows, _near_groups(near_rows)) if i == w]
    out = corpus_pipeline.near_duplicate_stage(spark, _docs(spark, near_rows), "")
    assert out.columns == _docs(spark, []).columns and sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text)) for r in out.collect())
    assert corpus_pipeline.near_duplicate_stage(spark, _docs(spark, []), "").count() == 0


def test_quality_bounds_of_each_side(spark):
    bins = [0] * 20 + [-10, 10] * 20 + [k * 15 for k in (-12, -9, -4, -2, 2, 4, 7, 9)]  # a scaled deviation is 14.826 bins
    rows = spark.createDataFrame([("en", 2 + k * quality.GRAIN, False) for k in bins] + [("en", 9.0, True), ("en", None, False)], "lang string, log_perplexity double, base_failed boolean")
    band = quality.perplexity_bands(rows).head()
    assert [k for k in (-12, -9, -4, -2, 2, 4, 7, 9) if not band.low <= 2 + k * 15 * quality.GRAIN <= band.high] == [-12, 4, 7, 9]
