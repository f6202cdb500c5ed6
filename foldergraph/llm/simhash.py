"""SimHash near-dedup: fingerprints linked at few differing bits, found in a hierarchical index in Gray order; and, with a higher bound on the
bits and an exact check of the pairs found, documents linked by the Jaccard similarity of their shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldergraph.llm.common import NO_ID, same_row, text_key
from foldergraph.operators.components import connected_components
from foldergraph.operators.skew import bucket, group_totals, lookup, salt
from foldergraph.sources.shared import cut, slices

SHINGLE_WORDS = 3
MOST_BITS = 3
SEED = 42
FANOUT = 8
#: Shingles whose bits are added at a time, and pairs of a query and a node that are held at a time.
STEP = 1 << 16
FRONTIER = 1 << 21
#: Fingerprints for which there is a bucket, and words of a part beyond which it is dealt to pairs of blocks.
BUCKET_ROWS = 1 << 17
PART_ROWS = 1 << 17

#: Near duplicates: five-word shingles, Jaccard similarity of SHARE[0] / SHARE[1] at least.
NEAR_WORDS = 5
SHARE = (4, 5)
#: Bits that fingerprints of so similar sets may differ in. At the bound a bit differs with probability 0.152, so that 24 of 64 are exceeded
#: less than once in 10^6 pairs.
NEAR_BITS = 24
#: Sets are compared that share one of BANDS keys of ROWS least hashes each; at the bound three pairs in 10^5 share none.
BANDS, ROWS = 20, 4
#: Classes of shingles of which a set's parities are kept; and the sets of other components that a set is compared with first.
MARKS = 512
PICKS = 3


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The XXH64 of a text's shingles in order; fewer words than a shingle are one shingle, no words none."""
    # bytes.split() without arguments splits at space and \\x09-\\x0D, bytes.lower() changes A-Z only
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    n, joined, digest = max(1, len(parts) - words + 1), b" ".join(parts), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[-n:] - 1).tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 if there are none."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        bits += np.unpackbits(hashes[k : k + STEP].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long) per row of docs."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(x, words) for x in frame.pop("text")], np.uint64)
            yield frame.assign(fp=fps.view(np.int64))

    # doc_id as string: pandas would make floats of nullable integers
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key().alias("text_key"), "text")
    found = rows.mapInPandas(each, "doc_id string, text_key long, fp long")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text_key", "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the order in which neighbours differ in one bit."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Words in Gray order, grouped level by level; a node keeps the bits that all words below it share.

    part: only words of equal part are compared. Levels go from the words up to one node a part.
    """

    def __init__(self, words: np.ndarray, part: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((gray_rank(words), part))
        self.words, part = words[self.order], part[self.order]
        mask, pattern, first = np.full(len(words), ~np.uint64(0)), self.words, np.arange(len(words))
        #: mask, pattern, and where a node's children begin in the level below and end
        self.levels = [(mask, pattern, None, None)]
        self.last = [np.arange(len(words))]
        while len(np.unique(part)) < len(part):
            start = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1]
            inside = np.arange(len(part)) - np.repeat(start, np.diff(np.r_[start, len(part)]))
            first = np.flatnonzero(inside % fanout == 0)
            both, either = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(both ^ either)
            end = np.r_[first[1:], len(part)]
            self.levels.append((shared, both & shared, first, end))
            self.last.append(self.last[-1][end - 1])
            mask, pattern, part = shared, both & shared, part[first]
        self.part, self.top = part, len(self.levels) - 1
        sizes = np.diff(np.r_[-1, self.last[-1]])
        self.root, self.most = np.repeat(np.arange(len(part)), sizes), int(sizes.max(initial=1))

    def pairs(self, most: int = MOST_BITS, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of all pairs of words of a part that differ in at most `most` bits, as places in the input."""
        step = max(1, frontier // max(self.most, 1))
        for at in range(0, len(self.words), step):
            query = np.arange(at, min(at + step, len(self.words)))
            node = self.root[query]
            mask, pattern, _, _ = self.levels[self.top]
            away = np.bitwise_count((self.words[query] ^ pattern[node]) & mask[node]).astype(np.int64)
            for level in range(self.top, 0, -1):
                near = (away <= most) & (self.last[level][node] > query)  # a pair is found from its earlier word
                query, node, away = query[near], node[near], away[near]
                mask, _, first, end = self.levels[level]
                n = end[node] - first[node]
                above = np.repeat(mask[node], n)
                child = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                query, away = np.repeat(query, n), np.repeat(away, n)
                mask, pattern, _, _ = self.levels[level - 1]
                # only the bits that the child adds to what its parents share
                away += np.bitwise_count((self.words[query] ^ pattern[child]) & mask[child] & ~above)
                node = child
            found = (away <= most) & (node > query)
            yield self.order[query[found]], self.order[node[found]]


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of n places is connected to."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(part, fp, ...) with bucket, and part made finer where it is large, so that all rows of a part meet in a bucket by twos.

    There are as many buckets as the rows need. A part of more than PART_ROWS rows is dealt to blocks by fp, and every row goes to each
    pair of blocks that its own is in: a task holds two blocks at most.
    """
    spark = rows.sparkSession
    buckets = max(4 * slices(spark), rows.count() // BUCKET_ROWS)
    large = rows.groupBy("part").agg(F.count("*").alias("k")).filter(F.col("k") > PART_ROWS).select("part", F.ceil(F.col("k") / PART_ROWS).cast("int").alias("blocks"))
    rows = lookup_some(rows, large, "part").withColumn("_own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("_other", other).withColumn("part", F.when(F.col("blocks").isNull(), F.col("part")).otherwise(F.xxhash64("part", F.least("_own", "_other"), F.greatest("_own", "_other"))))
    return rows.withColumn("bucket", bucket(buckets, "part")).drop("blocks", "_own", "_other")


def lookup_some(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table where it has the key, which any share of rows may have."""
    salted = rows.withColumn("_salt", salt(rows.sparkSession, "fp"))
    found = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(found, [key, "_salt"], "left").drop("_salt")


def fingerprint_links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """src, dst: links that connect the distinct fingerprints fps(fp) as all pairs within `most` bits do, without emitting all pairs.

    Two words that differ in `most` bits are alike in one of most + 1 blocks of bits; each word goes to a bucket for each of its
    blocks, and a bucket's index links the words of equal block there.
    """
    blocks = most + 1
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        words = frame["fp"].to_numpy().view(np.uint64)
        part = np.unique(frame["part"].to_numpy(), return_inverse=True)[1].ravel()
        order = np.argsort(words, kind="stable")
        words, part = words[order], part[order]
        root = local_roots(len(words), GrayIndex(words, part).pairs(most))
        away = root != np.arange(len(words))
        return pd.DataFrame({"src": words[away].view(np.int64), "dst": words[root[away]].view(np.int64)})

    value = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    routed = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), value(k)) for k in range(blocks)])).alias("part"))
    return _dealt(routed).groupBy("bucket").applyInPandas(link, "src long, dst long")


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text_key, fp, component_id (smallest doc_id reachable over links of at most `most` bits).

    A-Z count as a-z, words are parted by white space; fewer words than a shingle are one shingle. Texts without words,
    null among them, have fingerprint zero, which links like any other. A null doc_id takes part but is never a component_id
    unless its component has no other. Other columns are not carried.
    """
    prints = cut(fingerprints(docs, words), "prints").withColumn("_salt", salt(docs.sparkSession, "doc_id", "text_key"))
    fps = cut(prints.groupBy("fp", "_salt").agg(F.min("doc_id").alias("least")).groupBy("fp").agg(F.min("least").alias("least")), "fps")
    roots = connected_components(fingerprint_links(fps.select("fp"), most)).select(F.col("id").alias("fp"), "component")
    fps = fps.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp")).withColumn("_part", salt(docs.sparkSession, "fp"))
    fps = group_totals(fps, ["component"], "_part", component_id=("min", "least")).select("fp", "component_id", "component")
    return lookup(prints, fps, ["fp"], "_salt").select("doc_id", "text_key", "fp", "component_id", "component")


def band_keys(found: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS least hashes of a set; sets of Jaccard similarity J share a given key with probability J ** ROWS."""
    least = np.full(len(seeds), ~np.uint64(0))
    for k in range(0, len(found), STEP >> 4):
        part = found[k : k + (STEP >> 4)]
        np.minimum(least, ((part[None, :] ^ seeds[:, None]) * (seeds[:, None] | np.uint64(1))).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(-1, ROWS))], np.uint64).view(np.int64)


def shingle_prints(docs: DataFrame, words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, text_key, node (names the set of shingles), n (their number), fp (of the set), marks, bands (keys) per row of docs.

    marks: of MARKS classes of shingles, whether the set has an odd number; sets whose marks differ in k bits differ in k shingles at least.
    """
    seeds = np.array([xxhash.xxh64_intdigest(b"band", k) for k in range(BANDS * ROWS)], np.uint64)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                found = np.unique(shingles(text, words))
                odd = np.packbits(np.bincount((found % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1).tobytes()
                out.append((xxhash.xxh64_intdigest(found.tobytes(), SEED), len(found), majority(found), odd, band_keys(found, seeds)))
            node, n, fp, marks, bands = zip(*out) if out else ((),) * 5
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield frame[["doc_id", "text_key"]].assign(node=signed(node), n=np.array(n, np.int64), fp=signed(fp), marks=list(marks), bands=list(bands))

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key().alias("text_key"), "text")
    found = rows.mapInPandas(each, "doc_id string, text_key long, node long, n long, fp long, marks binary, bands array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _alike(n1: Column, n2: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n1, n2) * SHARE[1] >= F.greatest(n1, n2) * SHARE[0]


def similar_links(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """src, dst: those of pairs(src, dst) whose sets of shingles are similar enough. texts: (node, text), one text of each node that is in a pair."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"node": frame["node"], "shingles": [np.unique(shingles(x, words)).tobytes() for x in frame["text"]]})

    def similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["s1"], frame["s2"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both))
            yield frame.loc[good, ["src", "dst"]]

    found = cut(texts.mapInPandas(sets, "node long, shingles binary"), "sets")
    for end, other, name in (("src", "dst", "s1"), ("dst", "src", "s2")):
        pairs = lookup(pairs.withColumn("_salt", salt(pairs.sparkSession, other)), found.select(F.col("node").alias(end), F.col("shingles").alias(name)), [end], "_salt").drop("_salt")
    return cut(pairs.select("src", "dst", "s1", "s2").mapInPandas(similar, "src long, dst long"), "links")


def set_links(docs: DataFrame, prints: DataFrame, words: int) -> DataFrame:
    """src, dst: links that connect the nodes of prints as all pairs of similar sets do, without emitting all pairs of a large group.

    First each set is compared with the least node that shares a band with it, if their fingerprints are near. What that connects needs
    no more pairs: then only sets of different components that share a band are compared, those that the band's index in Gray order has
    within NEAR_BITS and whose marks don't rule similarity out. Of these each set first takes PICKS at random, which connects nearly all
    of a large group; then all that are still in different components are compared.
    """
    spark = docs.sparkSession
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("marks").alias("marks"), F.first("bands").alias("bands"), F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_key")).alias("at"))
    nodes = cut(nodes, "nodes")
    rows = nodes.select("node", "n", "fp", F.explode("bands").alias("part")).withColumn("_salt", salt(spark, "node"))
    hubs = rows.groupBy("part", "_salt").agg(F.min(F.struct("node", "n", "fp")).alias("hub"), F.max("node").alias("last")).groupBy("part").agg(F.min("hub").alias("hub"), F.max("last").alias("last"))
    rows = cut(lookup(rows, hubs.filter("hub.node < last").drop("last"), ["part"], "_salt").drop("_salt"), "bands")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= NEAR_BITS) & _alike(F.col("n"), F.col("hub.n"))
    stars = rows.filter((F.col("node") != F.col("hub.node")) & near).select(F.col("node").alias("src"), F.col("hub.node").alias("dst")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        ends = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()
        wanted = nodes.join(ends, "node", "left_semi").select("node", "at.doc", "at.text_key")
        keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
        return similar_links(pairs, keyed.join(wanted, ["doc", "text_key"]).select("node", "text").dropDuplicates(["node"]), words)

    def across(rows: DataFrame, links: DataFrame, picks: int | None) -> DataFrame:
        """src, dst: pairs that may be similar and that links don't connect; at most `picks` for a set and bucket."""
        found = cut(connected_components(links).withColumnRenamed("id", "node"), "found")
        rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("_salt", salt(spark, "node"))
        mixed = rows.groupBy("part").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("part", F.lit(True).alias("_mixed"))
        rows = cut(lookup(rows, mixed, ["part"], "_salt").drop("_salt", "_mixed"), "mixed")
        rows = rows.join(nodes.select("node", "marks"), "node")

        def search(frame: pd.DataFrame) -> pd.DataFrame:
            part = np.unique(frame["part"].to_numpy(), return_inverse=True)[1].ravel()
            node, component, n = (frame[c].to_numpy() for c in ("node", "component", "n"))
            marks = np.frombuffer(b"".join(frame["marks"]), np.uint64).reshape(len(frame), -1)
            out = np.zeros((0, 2), np.int64)
            for a, b in GrayIndex(frame["fp"].to_numpy().view(np.uint64), part).pairs(NEAR_BITS):
                apart = (component[a] != component[b]) & (np.minimum(n[a], n[b]) * SHARE[1] >= np.maximum(n[a], n[b]) * SHARE[0])
                a, b = a[apart], b[apart]
                differ = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int64)
                good = (SHARE[1] + SHARE[0]) * differ <= (SHARE[1] - SHARE[0]) * (n[a] + n[b])
                both = np.unique(np.sort(np.stack([node[a[good]], node[b[good]]], axis=1), axis=1), axis=0)
                out = np.unique(np.concatenate([out, both]), axis=0)
                if picks is not None:
                    out = _picked(out, picks)
            return pd.DataFrame(out, columns=["src", "dst"])

        return _dealt(rows).groupBy("bucket").applyInPandas(search, "src long, dst long").distinct()

    rows = rows.select("part", "node", "n", "fp")
    links = verified(stars)
    links = links.unionByName(verified(across(rows, links, PICKS)))
    return links.unionByName(verified(across(rows, links, None)))


def _picked(pairs: np.ndarray, picks: int) -> np.ndarray:
    """Of pairs of nodes those that are among the first `picks` of either node, in an order that a hash of the pair decides."""
    mixed = (pairs[:, 0] ^ pairs[:, 1]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keep = np.zeros(len(pairs), bool)
    for side in (0, 1):
        order = np.lexsort((mixed, pairs[:, side]))
        own = pairs[order, side]
        first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1] if len(own) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        keep[order[place < picks]] = True
    return pairs[keep]


def near_groups(docs: DataFrame, words: int = NEAR_WORDS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text_key, component_id (smallest doc_id reachable over links of similar texts).

    Texts are linked if the Jaccard similarity of their sets of shingles is 0.8 or more; A-Z count as a-z, words are parted by white
    space. Pairs are found by fingerprints and bands (see NEAR_BITS, BANDS), then checked exactly. Texts without words, null among
    them, are alike. A null doc_id takes part but is never a component_id unless its component has no other.
    """
    spark = docs.sparkSession
    prints = cut(shingle_prints(docs, words), "prints")
    roots = connected_components(set_links(docs, prints, words)).withColumnRenamed("id", "node")
    prints = prints.select("doc_id", "text_key", "node").withColumn("_salt", salt(spark, "doc_id", "text_key"))
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = group_totals(nodes.withColumn("_part", salt(spark, "node")), ["component"], "_part", component_id=("min", "least")).select("node", "component_id")
    return lookup(prints, nodes, ["node"], "_salt").select("doc_id", "text_key", "component_id")


def _first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_key().alias("text_key"))
    return same_row(keyed, stay, ["doc_id", "text_key"], "left_semi").select("row.*")


def simhash_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component of near fingerprints the row of the smallest doc_id.

    A component without any doc_id keeps all its rows, and rows that repeat that doc_id stay with it.
    """
    return _first_of_each(docs, simhash_groups(docs, words, most))


def near_dedup(docs: DataFrame, words: int = NEAR_WORDS) -> DataFrame:
    """The rows of docs(doc_id, text) that stay, with all their columns: of each component of near_groups() the row of the smallest doc_id.

    Texts without words, null among them, are one group; texts of fewer words than a shingle have their whole sequence for one. A
    component without any doc_id keeps all its rows, rows that repeat the doc_id and text that stays stay with it; other columns may
    have any names; an empty table stays empty.
    """
    return _first_of_each(docs, near_groups(docs, words))
