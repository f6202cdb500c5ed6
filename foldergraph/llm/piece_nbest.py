"""SentencePiece encoding and decoding: the n best segmentations by a backward A* search whose exact heuristic is the forward Viterbi score."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldergraph.llm.common import text_key

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
#: The model's own scores are places in the order of merges, not probabilities. A piece is given the log probability of its place in
#: that order by Zipf's law, shifted by so many places; this is a fixed rule, nothing is counted or trained.
SHIFT = 1000
#: Below the lowest piece score by this much: a character without a piece, which is written as its bytes.
UNKNOWN = 10.0
IDS = np.dtype("<u2")
#: A unit begins with spaces; no piece has a space after another character, so a segmentation is one of each unit.
_UNIT = re.compile(r" +[^ ]*")
_STEP = 4 << 20
_BLOCK = 1 << 18
_MOST_CACHED = 1 << 18
#: Units of so many characters are taken one by one: the steps of a run are as many as its longest unit has characters.
_LONG = 256
#: Steps of a path that are kept before all but the cheapest are dropped.
_MANY = 1 << 12
#: Bits of a hash by which its place is looked up.
_TOP = 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """A vocabulary: pieces with scores, and all their prefixes as a sorted array of hashes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.ids = {model.id_to_piece(i).replace("▁", " "): i for i in ids if not special(i)}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece has a space inside; units would not be independent")
        # a score of -1e9 marks pieces that were added to the vocabulary; they stand with characters that have no piece
        ranked = sorted((i for i in self.ids.values() if model.get_score(i) > -1e8), key=lambda i: (-model.get_score(i), i))
        chance = 1.0 / (np.arange(len(ranked)) + SHIFT)
        zipf = np.log(chance / chance.sum())
        self.unknown = float(zipf[-1]) - UNKNOWN
        self.score = np.full(len(ids), self.unknown)
        self.score[ranked] = zipf
        self.scores = self.score.tolist()
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.text = [b""] * len(ids)
        for p, i in self.ids.items():
            self.text[i] = p.encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        known: dict[int, int] = {}
        for p, i in self.ids.items():
            h = 0
            for k, c in enumerate(p):
                h = ((h ^ ord(c)) * int(_A) + int(_B)) % (1 << 64)
                known[h] = i if k == len(p) - 1 else known.get(h, -1)
        self.hashes = np.array([*sorted(known), 2**64 - 1], np.uint64)
        self.prefix_id = np.array([*(known[h] for h in sorted(known)), -1], np.int32)
        #: where hashes with the same upper bits begin
        self.begin = np.searchsorted(self.hashes[:-1], np.arange(1 << _TOP, dtype=np.uint64) << np.uint64(64 - _TOP)).astype(np.int32)
        self.begin = np.append(self.begin, np.int32(len(known)))
        self.most = int(np.diff(self.begin).max())
        if len(known) != len({p[:k] for p in self.ids for k in range(1, len(p) + 1)}):
            raise ValueError("two prefixes share a hash")

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix's, and the piece that ends there or -1."""
        k = self.begin[h >> np.uint64(64 - _TOP)]
        there = self.hashes[k] == h
        todo = np.flatnonzero(~there)
        for _ in range(self.most - 1):
            k[todo] += 1
            todo = todo[k[todo] < len(self.hashes) - 1]
            same = self.hashes[k[todo]] == h[todo]
            there[todo[same]] = True
            todo = todo[~same & (self.hashes[k[todo]] < h[todo])]
        return there, np.where(there, self.prefix_id[np.minimum(k, len(self.hashes) - 1)], np.int32(-1))

    def _edges(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of a lattice: where each starts, its length and id; -1 is a character without a piece. left: characters to the unit's end."""
        # only prefixes of pieces go on to the next length
        at, h = np.arange(len(code), dtype=np.int32), np.zeros(len(code), np.uint64)
        edges = []
        for n in range(1, self.longest + 1):
            h = (h ^ code[at + (n - 1)]) * _A + _B
            there, found = self._find(h)
            good = np.flatnonzero(found >= 0)
            if n == 1:
                lone = np.flatnonzero(found < 0)
                edges.append((at[lone], np.full(len(lone), 1, np.int32), np.full(len(lone), -1, np.int32)))
            edges.append((at[good], np.full(len(good), n, np.int32), found[good]))
            go = np.flatnonzero(there & (left[at] > n))
            if not len(go):
                break
            at, h = at[go], h[go]
        return tuple(np.concatenate(x) for x in zip(*edges))

    def best(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        """For each unit the ids of its best segmentation, its score, and how far the next best is below (inf: there is none).

        Forward Viterbi over all units at once: one step for each place in a unit. Of equal scores the longer last piece stands.
        """
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, units), np.int32, len(units))
        end = np.cumsum(size)
        begin = end - size
        unit = np.repeat(np.arange(len(units), dtype=np.int32), size)
        place = (np.arange(len(code)) - begin[unit]).astype(np.int32)
        left = size[unit] - place
        start, n, piece = self._edges(code, left)
        order = np.argsort(place[start], kind="stable")
        start, n, piece = start[order], n[order], piece[order]
        gain = np.where(piece >= 0, self.score[piece], self.unknown)
        # node k + u is the place before character k of unit u, so that units share no node
        source = start + unit[start]
        target = source + n
        two = np.full((len(code) + len(units), 2), -np.inf)  # the best and the second best way to a node
        two[begin + np.arange(len(units)), 0] = 0.0
        back = np.zeros(len(two), np.int32)
        cuts = np.searchsorted(place[start], np.arange(int(size.max(initial=0)) + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            t = target[a:b]
            new, old = two[source[a:b]] + gain[a:b, None], two[t]
            out = np.maximum(new, old)
            np.maximum(out[:, 1], np.minimum(new[:, 0], old[:, 0]), out=out[:, 1])
            two[t] = out
            better = np.flatnonzero(new[:, 0] > old[:, 0])
            back[t[better]] = better + a
        last = end + np.arange(len(units))
        now, who = last.copy(), np.arange(len(units))
        steps = []
        while len(who):
            edge = back[now]
            steps.append((who, edge))
            now = source[edge]
            go = now > (begin + np.arange(len(units)))[who]
            who, now = who[go], now[go]
        owner, edge = (np.concatenate(x) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner[::-1], kind="stable")
        ids = piece[edge[::-1][order]]
        data, stops = ids.astype(IDS).tobytes(), np.cumsum(np.bincount(owner, minlength=len(units)))
        bare = set(owner[::-1][order][ids < 0].tolist())
        gap = two[last, 0] - two[last, 1]
        out, a = [], 0
        for k, (b, value, below) in enumerate(zip(stops.tolist(), two[last, 0].tolist(), gap.tolist())):
            out.append((self._spelled(units[k], ids[a:b].tolist()) if k in bare else data[2 * a : 2 * b], value, below))
            a = b
        return out

    def _spelled(self, unit: str, path: list[int]) -> bytes:
        """The ids of a path of pieces, with bytes for each character without a piece (-1)."""
        out, at = [], 0
        for i in path:
            if i < 0:
                out += [self.byte[b] for b in unit[at].encode()]
                at += 1
            else:
                out.append(i)
                at += len(self.text[i].decode())
        return np.array(out, IDS).tobytes()

    def nbest(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a unit: (score, ids), by a backward A* search.

        The forward score of a place is the best that the part before it can add, so a step's loss against it is exact: a partial path
        costs what its steps lose. Steps without a loss lead on for nothing and are followed at once; the agenda gets the others, the n
        cheapest of each path taken up, and of equal cost the one nearest to the unit's start.
        """
        size, (sources, ids, gains, bounds) = len(unit), self._into(unit)
        forward, tight = [0.0] * (size + 1), [0] * (size + 1)
        for b in range(1, size + 1):  # of equal scores the longer last piece stands
            forward[b], back = max((forward[sources[k]] + gains[k], -k) for k in range(bounds[b], bounds[b + 1]))
            tight[b] = -back

        def down(place: int) -> list[int]:
            """The steps that lose nothing from a place to the start."""
            steps = []
            while place:
                steps.append(tight[place])
                place = sources[steps[-1]]
            return steps

        agenda, count, found = [(0.0, size, 0, [])], 1, []
        while agenda and len(found) < n:
            cost, place, _, behind = heapq.heappop(agenda)
            free = down(place)
            found.append((forward[size] - cost, self._spelled(unit, [ids[k] for k in [*free[::-1], *behind[::-1]]])))
            others, at = [], place
            for after, step in enumerate(free):
                high = forward[at]
                others += [(high - (forward[sources[k]] + gains[k]), sources[k], k, after) for k in range(bounds[at], bounds[at + 1]) if k != step]
                at = sources[step]
                if len(others) > _MANY:
                    others = heapq.nsmallest(n, others)
            for loss, at, k, after in heapq.nsmallest(n - len(found), others):
                heapq.heappush(agenda, (cost + loss, at, count, [*behind, *free[:after], k]))
                count += 1
        return found

    def _into(self, unit: str) -> tuple[list[int], list[int], list[float], list[int]]:
        """The pieces of a unit in order of their ends, longer ones first: starts, ids, scores, and where those that end at a place begin."""
        if len(unit) < _LONG:
            known, scores, sources, ids, gains, bounds = self.ids, self.scores, [], [], [], [0]
            for b in range(len(unit) + 1):
                for a in range(max(0, b - self.longest), b):
                    i = known.get(unit[a:b], -1)
                    if i >= 0 or a == b - 1:
                        sources.append(a)
                        ids.append(i)
                        gains.append(scores[i] if i >= 0 else self.unknown)
                bounds.append(len(ids))
            return sources, ids, gains, bounds
        start, length, piece = self._edges(np.frombuffer(unit.encode("utf-32-le"), np.uint32), np.arange(len(unit), 0, -1))
        order = np.lexsort((start, start + length))
        start, piece, stop = start[order], piece[order], (start + length)[order]
        gain = np.where(piece >= 0, self.score[piece], self.unknown)
        return start.tolist(), piece.tolist(), gain.tolist(), np.searchsorted(stop, np.arange(len(unit) + 2)).tolist()

    def best_two(self, unit: str) -> tuple[bytes, float, float]:
        """What best gives for a unit, from its two best segmentations."""
        (score, ids), *other = self.nbest(unit, 2)
        return ids, score, score - other[0][0] if other else np.inf

    def decoded(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, less the space that encoding puts first."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:].decode(errors="replace")


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts; keeps the units it has met lately, each under its text less the first space."""

    def __init__(self, path: str, nbest: int):
        self.pieces, self.n = pieces(path), nbest
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.ids: list[bytes] = []
        self.size, self.score, self.gap = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.good = np.zeros(0, bool)
        self.others: dict[int, list[tuple[float, bytes]]] = {}

    def parted(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text, as places in ids, size, score and gap."""
        own = [[u[1:] for u in _UNIT.findall(" " + x)] if "  " in x or x.startswith(" ") else x.split(" ") for x in texts]
        if len(self.known) > _MOST_CACHED:
            self.forget()
        new = sorted({u for x in own for u in x} - self.known.keys(), key=len)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        found: list[tuple[bytes, float, float]] = []
        run, size = [], 0
        for k, u in enumerate(new):
            if len(u) >= _LONG:
                found.append(self.pieces.best_two(" " + u))
                continue
            run.append(" " + u)
            size += len(u) + 1
            if size >= _BLOCK or k == len(new) - 1 or len(new[k + 1]) >= _LONG:
                found += self.pieces.best(run)
                run, size = [], 0
        if new:
            ids, score, gap = zip(*found)
            self.names += new
            self.ids += ids
            self.size = np.r_[self.size, np.fromiter(map(len, ids), np.int64, len(ids)) // IDS.itemsize]
            self.score, self.gap = np.r_[self.score, score], np.r_[self.gap, gap]
            self.good = np.r_[self.good, [self.pieces.decoded(np.frombuffer(x, IDS)) == u for x, u in zip(ids, new)]]
        return [np.fromiter(map(self.known.__getitem__, x), np.int64, len(x)) for x in own]

    def ranked(self, unit: int) -> list[tuple[float, bytes]]:
        if unit not in self.others:
            self.others[unit] = self.pieces.nbest(" " + self.names[unit], self.n)
        return self.others[unit]

    def encoded(self, units: np.ndarray) -> tuple[bytes, list[dict], bool]:
        """Ids of the best segmentation; the n best: score and edits (place in the best ids, ids left out, ids put in); whether
        decoding gives the text back, which it does if it does for each unit.

        Only the n - 1 units whose next best is nearest can differ among the n best: any other costs more than each of these alone.
        """
        gap = self.gap[units]
        few = np.argpartition(gap, self.n - 2)[: self.n - 1] if 1 < self.n <= len(gap) else np.arange(len(gap) * (self.n > 1))
        near = np.sort(few[np.isfinite(gap[few])])
        best: list[tuple[float, tuple]] = [(0.0, ())]
        for k in near.tolist():
            ways = self.ranked(int(units[k]))
            best = heapq.nsmallest(self.n, [(cost + ways[0][0] - s, (*edits, (k, ids)) if j else edits) for cost, edits in best for j, (s, ids) in enumerate(ways)])
        size, score = self.size[units], float(self.score[units].sum())
        ends = np.cumsum(size) - size
        nbest = [{"score": score - cost, "edits": [{"at": int(ends[k]), "n": int(size[k]), "ids": ids} for k, ids in edits]} for cost, edits in best]
        return b"".join(map(self.ids.__getitem__, units.tolist())), nbest, bool(self.good[units].all())


ENCODED = "doc_id string, text_key long, ids binary, nbest array<struct<score: double, edits: array<struct<at: int, n: int, ids: binary>>>>, round_trip boolean"


def encode(docs: DataFrame, path: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text_key, ids (16 bits each), nbest, round_trip.

    The scores are not the model's own, which are places in the order of its merges: a piece has the log probability of its place by
    Zipf's law (see SHIFT), so ids are not always those that the library gives for this model; they decode to the same text.
    ids: the segmentation with the highest sum of piece scores, a space put before the text; characters without a piece become
    their bytes. nbest: up to so many best segmentations of the whole text, the best first, as edits of ids. round_trip: decoding
    gives the text back. Null counts as empty, which is a single space; repeated rows are encoded again; other columns are not carried.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, nbest)
        for frame in frames:
            size = np.cumsum([len(x) for x in frame["text"]]) // _STEP
            for _, part in frame.groupby(size, sort=False):
                texts = part["text"].tolist()
                ids, best, same = zip(*map(encoder.encoded, encoder.parted(texts)))
                yield pd.DataFrame({"doc_id": part["doc_id"], "text_key": part["text_key"], "ids": ids, "nbest": best, "round_trip": same})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, ENCODED).withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows with ids (16 bits each) -> the same rows with text; null ids give null, ids that no encoding gives decode as they can."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        table = pieces(path)
        return ids.map(lambda x: None if x is None else table.decoded(np.frombuffer(x, IDS)))

    return rows.withColumn("text", run("ids"))
