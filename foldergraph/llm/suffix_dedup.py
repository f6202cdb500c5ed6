"""Suffix-array dedup: bytes in strings of 50 that also start in a document with a smaller id are removed.

A job can't sort all suffixes of a corpus in one array, so strings are dealt to buckets by a key that only their own 50 bytes
decide (the least hash of the 18-byte grams in them): equal strings meet in one bucket. There a suffix array of the bucket's
texts is made by two-stage sorting, and adjacent suffixes with a common prefix of 50 bytes or more form a class of equal
strings. Keys that occur in one document only can't hold a repetition; a first round over the keys finds them, so that
only texts around shared keys move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldergraph.llm.common import NO_ID
from foldergraph.sources.shared import cut

LENGTH = 50
GRAM = 18
#: A key with more pieces than this is dealt on by whole strings instead, so that no bucket must take them all.
HOT = 2048
MIX = np.uint64(0x9E3779B97F4A7C15)
GROUP_BYTES = (256 << 10, 32 << 20)
#: Text for which there is a bucket of keys, and one of pieces.
BUCKET_BYTES = 4 << 20
ANSWER = np.dtype([("piece", "<u4"), ("start", "<u2"), ("n", "<u2"), ("doc", "<i8")])


def window_keys(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each position with `length` bytes from there on, the least hash of the grams in them."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)

    def doubled(one: np.ndarray, size: int, join) -> np.ndarray:  # noqa: ANN001
        """join of each `size` neighbours, from joins of 1, 2, 4, ... neighbours."""
        out, have, power = None, 0, 1
        while True:
            if size & power:
                out = one if out is None else join(out[: len(out) - power], one[have:], power)
                have += power
            if power * 2 > size:
                return out[: len(raw)]
            one, power = join(one[:-power], one[power:], power), power * 2

    factors: dict[int, np.uint64] = {}

    def chained(a: np.ndarray, b: np.ndarray, power: int) -> np.ndarray:
        if power not in factors:
            factors[power] = np.uint64(pow(int(MIX), power, 1 << 64))
        n = min(len(a), len(b))
        return a[:n] * factors[power] + b[:n]

    def least(a: np.ndarray, b: np.ndarray, power: int) -> np.ndarray:
        n = min(len(a), len(b))
        return np.minimum(a[:n], b[:n])

    h = doubled((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), gram, chained)[: len(raw) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return doubled(h, length - gram + 1, least)[: len(raw) - length + 1]


class Runs:
    """The runs of neighbouring strings of equal key in a group of documents; documents are in order of (doc, text)."""

    def __init__(self, frame: pd.DataFrame, length: int = LENGTH):
        self.rows = frame.sort_values(["doc", "text"], kind="stable")
        texts = [x.encode() for x in self.rows["text"]]
        self.raw, self.length = b"".join(texts), length
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(self.sizes)
        self.begins, self.ends = ends - self.sizes, ends
        self.ids = self.rows["doc"].to_numpy(np.int64)
        key = window_keys(np.frombuffer(self.raw, np.uint8), length)
        row = np.repeat(np.arange(len(texts)), self.sizes)[: len(key)]
        good = np.arange(len(key)) + length <= ends[row]
        new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][: len(key)]
        at = np.flatnonzero(new & good)
        stop = np.minimum(np.r_[np.flatnonzero(new), len(key)][np.searchsorted(np.flatnonzero(new), at) + 1], ends[row[at]] - length + 1)
        # long runs (periodic text) are cut, so that a piece has a bounded size
        n, most = stop - at, 2 * (length - GRAM + 1)
        parts = (n + most - 1) // most
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(at, parts) + inside * most
        self.n = np.minimum(np.repeat(stop, parts) - self.start, most)
        self.key, self.row = np.repeat(key[at], parts), np.repeat(row[at], parts)

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order of (bucket, key), their buckets, and each run's place among them."""
        found, place = np.unique(self.key, return_inverse=True)
        bucket = ((found >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return found[order], bucket[order], back[place.ravel()]

    def pieces(self, flags: np.ndarray, place: np.ndarray, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces around shared keys, their buckets, and for each occurrence its piece and position.

        Runs of a hot key are cut into strings, which are dealt by their own hash.
        """
        flag = flags[place]
        hot, warm = np.flatnonzero(flag == 2), np.flatnonzero(flag == 1)
        n = self.n[hot]
        start = np.r_[self.start[warm], np.repeat(self.start[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        end = start + self.length - 1 + np.r_[self.n[warm], np.ones(n.sum(), np.int64)]
        names: dict[bytes, int] = {}
        of = np.fromiter((names.setdefault(self.raw[a:b], len(names)) for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start))
        texts = list(names)
        first = np.unique(of, return_index=True)[1]
        warm_bucket = ((self.key[warm] >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
        bucket = np.fromiter((warm_bucket[i] if i < len(warm) else xxhash.xxh64_intdigest(texts[k]) % buckets for k, i in enumerate(first.tolist())), np.int64, len(texts))
        return texts, bucket, of, start


def _split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal numbers in a sorted array."""
    at = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)] if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield int(bucket[a]), slice(a, b)


def _binary(rows: list[tuple], names: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names.split())


def suffix_array(raw: bytes, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions where `wanted` is set, and what is needed to place them, in order of the first `depth` bytes from there on.

    raw has no byte 0 but separators. Two stages: suffixes smaller than their successors are sorted directly; one that is
    larger than its successor goes, as the buckets of first bytes are scanned in order, behind those already placed in its
    own bucket when its successor is met.
    """
    text = np.frombuffer(raw + bytes(depth + 8), np.uint8)
    n = len(raw)
    step = np.sign(text[1 : n + 1].astype(np.int16) - text[:n])
    # at equal neighbours the next change decides
    change = np.where(step != 0, np.arange(n), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    larger = step[change] <= 0
    following = np.minimum.accumulate(np.where(larger, n - 1, np.arange(n))[::-1])[::-1]  # the next one sorted directly
    need = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(need, at, 1)
    np.add.at(need, following[at] + 1, -1)
    need = np.cumsum(need[:n]) > 0
    direct = np.flatnonzero(need & ~larger)
    view = np.ndarray((n,), f"S{depth}", buffer=text, strides=(1,))
    direct = direct[np.argsort(view[direct], kind="stable")]
    induced = need & larger
    # the last suffix has no successor that could place it
    tail = np.flatnonzero(induced[n - 1 :]) + n - 1
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    for p in tail:
        waiting[text[p]].append(np.array([p]))
    out = []
    for c in range(256):
        part = waiting[c]
        own = np.concatenate(part) if part else np.zeros(0, np.int64)
        rounds = [own]
        while len(own):
            own = own[own > 0] - 1
            own = own[induced[own] & (text[own] == c)]
            rounds.append(own)
        bucket = np.concatenate([*rounds, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        char = text[before]
        before, char = before[char > c], char[char > c]
        order = np.argsort(char, kind="stable")
        for d, cut in _split(char[order]):
            waiting[d].append(before[order[cut]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


#: 256 ** k: a number has as many bytes as there are powers up to it.
_POWERS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def common_prefix(raw: bytes, a: np.ndarray, b: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """How many bytes, up to depth, the strings from a and from b on share."""
    text = np.frombuffer(raw + bytes(depth + 8), np.uint8)
    words = np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,))
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, depth, 8):
        if not len(alive):
            break
        off = (words[a[alive] + at] ^ words[b[alive] + at]).astype(np.uint64)
        same = 8 - np.searchsorted(_POWERS, off, "right")
        out[alive] += same
        alive = alive[off == 0]
    return np.minimum(out, depth)


def least_docs(pieces: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every string of `length` in the pieces, in order, the smallest doc of a piece that has it; and each piece's count of strings."""
    raw = b"\x00".join(x.translate(_UP) for x in pieces) + b"\x00"
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(sizes + 1) - sizes - 1
    n = sizes - length + 1
    starts = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
    wanted = np.zeros(len(raw), bool)
    wanted[starts] = True
    order = suffix_array(raw, wanted, length)
    order = order[wanted[order]]
    new = np.r_[True, common_prefix(raw, order[:-1], order[1:], length) < length]
    at = np.flatnonzero(new)
    doc = np.zeros(len(raw), np.int64)
    doc[starts] = np.repeat(docs, n)
    doc[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.r_[at, len(order)]))
    return doc[starts], n


#: Each byte one higher, which leaves 0 for separators; no UTF-8 has byte 255.
_UP = bytes([*range(1, 256), 255])


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, start, end, ...).

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of `length` bytes that covers it also starts in a row with
    a smaller doc_id, judged on the input. Rows of one doc_id don't act on each other; a null doc_id counts as the smallest.
    A text shorter than `length` stays whole. Other columns are not carried. Each group of documents sends a distinct piece of
    text once, so a bucket gets a passage at most as often as there are groups, however many documents have it.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    size = min(GROUP_BYTES[1], max(GROUP_BYTES[0], total // 2000))
    groups, buckets = max(1, total // size), max(1, total // BUCKET_BYTES)
    doc = F.coalesce("doc_id", F.lit(NO_ID))
    rows = docs.select(F.pmod(F.xxhash64(doc), F.lit(groups)).cast("int").alias("g"), doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))

    def group_keys(frame: pd.DataFrame) -> pd.DataFrame:
        runs = Runs(frame, length)
        found, bucket, place = runs.keys(buckets)
        low, high = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(low, place, runs.ids[runs.row])
        np.maximum.at(high, place, runs.ids[runs.row])
        info = (np.minimum(np.bincount(place, minlength=len(found)), 127) | ((low != high) << 7)).astype(np.uint8)
        short, g = found.astype(np.uint32), int(frame["g"].iloc[0])
        return _binary([(b, g, short[s].tobytes(), info[s].tobytes()) for b, s in _split(bucket)], "b g keys info")

    def bucket_flags(frame: pd.DataFrame) -> pd.DataFrame:
        keys, info = (np.frombuffer(b"".join(frame[c]), t) for c, t in (("keys", np.uint32), ("info", np.uint8)))
        _, place, seen = np.unique(keys, return_inverse=True, return_counts=True)
        place = place.ravel()
        many = np.bincount(place, (info & 127).astype(np.float64), len(seen)) > HOT
        shared = (seen > 1) | (np.bincount(place, info >> 7, len(seen)) > 0)
        flags = (shared.astype(np.uint8) * (1 + many.astype(np.uint8)))[place]
        at = np.cumsum([0, *(len(x) // 4 for x in frame["keys"])])
        return _binary([(g, 0, b, flags[i:j].tobytes()) for g, b, i, j in zip(frame["g"], frame["b"], at[:-1], at[1:])], "g kind b data")

    def found_pieces(frame: pd.DataFrame, told: pd.DataFrame):  # noqa: ANN202
        runs = Runs(frame, length)
        found, _, place = runs.keys(buckets)
        flags = told[told["kind"] == 0].sort_values("b")["data"]
        flags = np.frombuffer(b"".join(flags), np.uint8) if len(flags) else np.zeros(len(found), np.uint8)
        return runs, *runs.pieces(flags, place, buckets)

    def group_pieces(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = "b g sizes low high data"
        if not len(frame) or not len(told):
            return _binary([], names)
        runs, texts, bucket, of, start = found_pieces(frame, told)
        ids = runs.ids[np.searchsorted(runs.ends, start, "right")]
        low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), np.iinfo(np.int64).min)
        np.minimum.at(low, of, ids)
        np.maximum.at(high, of, ids)
        order = np.argsort(bucket, kind="stable")
        sizes, g = np.fromiter(map(len, texts), np.uint16, len(texts)), int(frame["g"].iloc[0])
        return _binary([(b, g, sizes[k].tobytes(), low[k].tobytes(), high[k].tobytes(), b"".join(texts[i] for i in k.tolist())) for b, s in _split(bucket[order]) for k in (order[s],)], names)

    def bucket_answers(frame: pd.DataFrame) -> pd.DataFrame:
        sizes, low, high = (np.frombuffer(b"".join(frame[c]), t) for c, t in (("sizes", np.uint16), ("low", np.int64), ("high", np.int64)))
        raw, ends = b"".join(frame["data"]), np.cumsum(sizes.astype(np.int64))
        names: dict[bytes, int] = {}
        of = np.fromiter((names.setdefault(raw[a:b], len(names)) for a, b in zip((ends - sizes).tolist(), ends.tolist())), np.int64, len(sizes))
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, of, low)
        doc, n = least_docs(list(names), least, length)
        piece = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])])
        run_n, run_doc, run_piece = np.diff(np.r_[at, len(doc)]), doc[at], piece[at]
        run_start = at - (np.cumsum(n) - n)[run_piece]
        first = np.searchsorted(run_piece, np.arange(len(n) + 1))
        times = np.diff(first)[of]
        member = np.repeat(np.arange(len(of)), times)
        run = np.arange(len(member)) - np.repeat(np.cumsum(times) - times - first[of], times)
        good = run_doc[run] < high[member]
        member, run = member[good], run[good]
        counts = np.fromiter((len(x) // 2 for x in frame["sizes"]), np.int64, len(frame))
        base = np.cumsum(counts) - counts
        row = np.searchsorted(base + counts, member, "right")
        out = np.zeros(len(member), ANSWER)
        out["piece"], out["start"], out["n"], out["doc"] = member - base[row], run_start[run], run_n[run], run_doc[run]
        gs, b = frame["g"].to_numpy(), int(frame["b"].iloc[0])
        return _binary([(int(gs[r]), 1, b, out[s].tobytes()) for r, s in _split(row)], "g kind b data")

    def group_result(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        runs, texts, bucket, of, start = found_pieces(frame, told)
        order = np.argsort(bucket, kind="stable")
        offset = dict(zip(*(x.tolist() for x in np.unique(bucket[order], return_index=True))))
        answers = told[told["kind"] == 1]
        got = [np.frombuffer(x, ANSWER) for x in answers["data"]]
        cover = np.zeros(len(runs.raw) + 1, np.int32)
        if got:
            piece = order[np.concatenate([x["piece"].astype(np.int64) + offset[b] for b, x in zip(answers["b"], got)])]
            got = np.concatenate(got)
            by = np.argsort(of, kind="stable")
            first = np.searchsorted(of[by], np.arange(len(texts) + 1))
            times = np.diff(first)[piece]
            k = np.repeat(np.arange(len(piece)), times)
            at = start[by[np.arange(len(k)) - np.repeat(np.cumsum(times) - times - first[piece], times)]]
            good = runs.ids[np.searchsorted(runs.ends, at, "right")] > got["doc"][k]
            at, k = at[good] + got["start"][k[good]], k[good]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + got["n"][k] - 1 + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out = []
        for a, b, doc in zip(runs.begins.tolist(), runs.ends.tolist(), runs.ids.tolist()):
            edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
            kept, last = hashlib.sha256(), a
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                kept.update(runs.raw[last : a + s])
                last = a + e
            kept.update(runs.raw[last:b])
            out.append((doc, b - a, int((edge[1::2] - edge[::2]).sum()), len(edge) // 2, kept.hexdigest(), edge))
        return pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    told = "g int, kind int, b int, data binary"
    flags = cut(rows.groupBy("g").applyInPandas(group_keys, "b int, g int, keys binary, info binary").groupBy("b").applyInPandas(bucket_flags, told), "flags")
    pieces = rows.groupBy("g").cogroup(flags.groupBy("g")).applyInPandas(group_pieces, "b int, g int, sizes binary, low binary, high binary, data binary")
    answers = cut(pieces.groupBy("b").applyInPandas(bucket_answers, told), "answers")
    result = rows.groupBy("g").cogroup(flags.unionByName(answers).groupBy("g")).applyInPandas(group_result, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return result.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
