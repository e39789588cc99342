"""Benchmark passages in documents: SimHashes of item-sized windows, a multi-index of Hamming blocks, exact verification."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm import tokens
from cueloom.llm.common import checked, known, staged, unused

SHINGLE = 5
LEAST = 0.8
BITS = 64
#: Distance of SimHashes up to which windows are verified: of windows of similarity 0.8 about one in a hundred is further away.
RADIUS = 17
#: Weights of shingles are whole multiples of 1 / SCALE in the votes, so that running sums are exact.
SCALE = 64
BLOCK_BYTES = 8 << 20

_U = np.uint64


def _bits(hashes: np.ndarray) -> np.ndarray:
    """-1 or 1 for every bit of every hash."""
    raw = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return raw.astype(np.int32) * 2 - 1


def _simhash(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1).reshape(-1, 8).copy().view(_U).ravel()


def _cuts(radius: int) -> list[tuple[int, int]]:
    """radius + 1 blocks of bits: fingerprints within the radius agree in one block at least."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return list(zip(edges, edges[1:], strict=False))


class Items:
    """A block of benchmark items: word hashes, shingles, fingerprints and the index of their blocks."""

    def __init__(self, texts: list[str], radius: int | None, weights: Counter, n_items: int, least: float = LEAST) -> None:
        self.radius, self.words, self.least = radius, [], least
        self.weights, self.rare = weights, math.log(1 + n_items)
        self.often, self.often_heft = self._heavy()
        prints, owners, keys, keyed, grams, own = [], [], [], [], {}, []
        for i, text in enumerate(texts):
            low = tokens.fold(np.frombuffer(text.encode(), np.uint8))
            hashes, _, begins, ends = tokens.words(low, np.array([0, len(low)]), tokens.LETTERS)
            self.words.append([low[b:e].tobytes() for b, e in zip(begins, ends, strict=True)])
            k = min(SHINGLE, len(hashes))
            if k:
                owners.append(i)
                own.append(tokens.shingles(hashes, np.zeros(len(hashes), np.int64), k)[0])
                grams.setdefault(k, []).append((own[-1], np.full(len(own[-1]), len(hashes))))
                prints.append(_simhash((_bits(own[-1]) * self.heft(own[-1])[:, None]).sum(axis=0)[None])[0])
            else:
                prints.append(_U(0))
        self.prints = np.array(prints, _U)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        # Which shingles items of which word count have.
        self.grams, self.seen = {}, {}
        for k, parts in grams.items():
            values, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((size, values))
            values, size = values[order], size[order]
            new = np.append(True, (values[1:] != values[:-1]) | (size[1:] != size[:-1]))
            self.grams[k] = values[new], size[new]
            self.seen[k] = np.zeros(1 << 20, bool)
            self.seen[k][(values >> _U(44)).astype(np.int64)] = True
        for b, (lo, hi) in enumerate(_cuts(radius) if radius is not None else []):
            keys.append(self._keys(self.sizes[owners], self.prints[owners], b, lo, hi))
            keyed.append(np.array(owners))
        keys, keyed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, keyed))
        order = np.argsort(keys, kind="stable")
        self.keys, self.keyed = keys[order], keyed[order]
        self.counts = [Counter(_runs(w)) for w in self.words]
        # For the exact search: the rarest shingles of every item, so many that whoever has none of them has too little in common with it.
        self.total, self.shares, index = {}, {}, {}
        for i, hashed in zip(owners, own, strict=True):
            runs = _runs(self.words[i])
            weight = np.array([weights.get(g, self.rare) for g in runs])
            values, first, many = np.unique(hashed, return_index=True, return_counts=True)
            weight = weight[first]
            self.total[i], self.shares[i] = float((weight * many).sum()), (values, weight)
            order = np.argsort(-weight, kind="stable")
            held = np.cumsum((weight * many)[order])
            rarest = order[: int(np.searchsorted(held, (1 - least) * self.total[i] + 1e-9, "right")) + 1]
            index.setdefault(len(runs[0]), []).append((values[rarest], np.full(len(rarest), i)))
        self.index = {}
        for k, parts in index.items():
            values, held = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(values, kind="stable")
            self.index[k] = values[order], held[order]

    def _heavy(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the shingles that several items have, and their weights as whole numbers."""
        parts = [(np.zeros(0, _U), np.zeros(0, np.int64))]
        for k in {len(g) for g in self.weights}:
            grams = [g for g in self.weights if len(g) == k]
            lines = [b" ".join(g) + b" " for g in grams]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
            hashes, rows, _, _ = tokens.words(np.frombuffer(b"".join(lines), np.uint8), offsets, tokens.LETTERS)
            parts.append((tokens.shingles(hashes, rows, k)[0], np.array([max(1, round(self.weights[g] * SCALE)) for g in grams])))
        values, heft = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(values)
        return values[order], heft[order]

    def heft(self, grams: np.ndarray) -> np.ndarray:
        """Weights of shingles as whole numbers."""
        out = np.full(len(grams), max(1, round(self.rare * SCALE)), np.int32)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, grams), len(self.often) - 1)
            met = self.often[at] == grams
            out[met] = self.often_heft[at[met]]
        return out

    @staticmethod
    def _keys(sizes: np.ndarray, prints: np.ndarray, block: int, lo: int, hi: int) -> np.ndarray:
        part = (prints >> _U(lo)) & _U((1 << (hi - lo)) - 1)
        return (sizes.astype(np.int64) << 24) | (block << 16) | part.astype(np.int64)

    def candidates(self, sizes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs of one size within the radius."""
        at, items = [], []
        for b, (lo, hi) in enumerate(_cuts(self.radius)):
            keys = self._keys(sizes, prints, b, lo, hi)
            first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            many = last - first
            at.append(np.repeat(np.arange(len(keys)), many))
            items.append(self.keyed[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())])
        pair = np.unique(np.concatenate(at) * len(self.sizes) + np.concatenate(items))
        at, items = pair // len(self.sizes), pair % len(self.sizes)
        far = np.bitwise_count(prints[at] ^ self.prints[items])
        near = far <= self.radius
        return at[near], items[near], far[near]

    def sharing(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, item, bound) of all windows that have enough shingles in common with an item, best bounds of a pair first.

        Windows have the item's word count; a row of fewer words is a window as a whole.
        """
        out: list[list] = [[], [], [], []]
        for k, (values, held) in self.index.items():
            grams, at = tokens.shingles(hashes, rows, k)
            low, high = np.searchsorted(values, grams, "left"), np.searchsorted(values, grams, "right")
            many = high - low
            place = np.repeat(at, many)
            item = held[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            for r, i in sorted(set(zip(rows[place].tolist(), item.tolist(), strict=True))):
                first, last = np.searchsorted(rows, r, "left"), np.searchsorted(rows, r, "right")
                base, size = np.searchsorted(at, first), min(int(self.sizes[i]), int(last - first))
                here = grams[base : base + last - first - k + 1]
                known_grams, weight = self.shares[i]
                found = np.minimum(np.searchsorted(known_grams, here), len(known_grams) - 1)
                mass = np.concatenate([[0.0], np.cumsum(np.where(known_grams[found] == here, weight[found], 0.0))])
                bound = (mass[size - k + 1 :] - mass[: len(mass) - (size - k + 1)]) / self.total[i]
                start = np.flatnonzero(bound >= self.least - 1e-9)
                start = start[np.argsort(-bound[start], kind="stable")]
                for held_in, x in zip(out, (first + start, np.full(len(start), size), np.full(len(start), i), bound[start]), strict=True):
                    held_in.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)

    def similarity(self, item: int, words: list[bytes]) -> float:
        """Weighted Jaccard similarity of the shingle counts."""
        mine, other = self.counts[item], Counter(_runs(words))
        least = most = 0.0
        for gram in mine.keys() | other.keys():
            w = self.weights.get(gram, self.rare)
            least += w * min(mine[gram], other[gram])
            most += w * max(mine[gram], other[gram])
        return least / most if most else 0.0


def _runs(words: list[bytes]) -> list[tuple]:
    k = min(SHINGLE, len(words))
    return list(zip(*[words[i:] for i in range(k)], strict=False)) if k else []


def _windows(items: Items, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per item size: (size, starts, word counts, votes of stretches, places in them) of the windows to look up.

    A window is looked up where it has a shingle of an item of its size; no other one can be similar. Where a text has
    fewer words than the items, it is a window as a whole. Votes are running sums over the shingles that windows cover.
    """
    firsts = np.searchsorted(rows, rows, "left")
    lasts = np.searchsorted(rows, rows, "right")
    for k, (values, size_of) in items.grams.items():
        grams, at = tokens.shingles(hashes, rows, k)
        hit = np.flatnonzero(items.seen[k][(grams >> _U(44)).astype(np.int64)])
        low, high = np.searchsorted(values, grams[hit], "left"), np.searchsorted(values, grams[hit], "right")
        many = high - low
        place = np.repeat(at[hit], many)
        sizes = size_of[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
        if not len(place):
            continue
        found = []
        for size in np.unique(sizes).tolist():
            own = np.unique(place[sizes == size])
            whole = lasts[own] - firsts[own] < size
            mark = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(mark, np.maximum(own[~whole] - (size - k), firsts[own[~whole]]), 1)
            np.add.at(mark, np.minimum(own[~whole], lasts[own[~whole]] - size) + 1, -1)
            start = np.concatenate([np.flatnonzero(np.cumsum(mark[:-1]) > 0), np.unique(firsts[own[whole]])])
            found.append((size, start, np.minimum(size, lasts[start] - start)))
        start, count = (np.concatenate([x[i] for x in found]) for i in (1, 2))
        mark = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + count - k + 1, -1)
        covered = np.cumsum(mark[:-1]) > 0
        held = covered[at]
        votes = np.zeros((int(covered.sum()) + 1, BITS), np.int32)
        places = np.concatenate([[0], np.cumsum(covered)])
        votes[places[at[held]] + 1] = _bits(grams[held]) * items.heft(grams[held])[:, None]
        np.cumsum(votes, axis=0, out=votes)
        for size, begin, words in found:
            for i in range(0, len(begin), 20_000):
                part = slice(i, i + 20_000)
                yield size, begin[part], words[part], _simhash(votes[places[begin[part] + words[part] - k + 1]] - votes[places[begin[part]]])


def _exact(items: Items, hashes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """(start, words, item, bound, distance) of all windows that can be similar, found by rare shingles instead of fingerprints."""
    start, size, item, bound = items.sharing(hashes, rows)
    return [start, size, item, bound, np.zeros(len(start), np.int64)]


def _near(items: Items, hashes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """(start, words, item, 1, distance) of the windows within the radius of an item of their size."""
    out = [[np.zeros(0, np.int64)] for _ in range(5)]
    for size, start, words, prints in _windows(items, hashes, rows):
        at, item, far = items.candidates(np.full(len(start), size), prints)
        for held, x in zip(out, (start[at], words[at], item, np.ones(len(at)), far), strict=True):
            held.append(x)
    return [np.concatenate(x) for x in out]


def _searcher(texts: list[str], ids: list, radius: int | None, least: float, weights: Counter, n_items: int):
    def run(batches):
        items = Items(texts, radius, weights, n_items, least)
        for batch in batches:
            keys = batch.column(0)
            rows_out, item_out, sims, fars, spans = [], [], [], [], []
            for row, data, offsets in tokens.text_chunks(batch.column(1)):
                low = tokens.fold(data)
                hashes, rows, begins, ends = tokens.words(low, offsets, tokens.LETTERS)
                starts, sizes, item, bound, far = (_exact if radius is None else _near)(items, hashes, rows)
                best: dict = {}
                for s, m, i, most, d in zip(starts.tolist(), sizes.tolist(), item.tolist(), bound.tolist(), far.tolist(), strict=True):
                    if most + 1e-9 < best.get((int(rows[s]), i), ((0.0,), 0))[0][0]:
                        continue
                    sim = items.similarity(i, [low[b:e].tobytes() for b, e in zip(begins[s : s + m], ends[s : s + m], strict=True)])
                    own = (sim, -d, -s)
                    if sim >= least and own > best.get((int(rows[s]), i), ((-1.0,), 0))[0]:
                        best[int(rows[s]), i] = (own, (int(begins[s] - offsets[rows[s]]), int(ends[s + m - 1] - offsets[rows[s]])))
                for (r, i), ((sim, d, _), span) in sorted(best.items()):
                    rows_out.append(row + r)
                    item_out.append(ids[i])
                    sims.append(sim)
                    fars.append(-d)
                    spans.append(span)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows_out, pa.int64())), pa.array(item_out, pa.int64()), pa.array(sims, pa.float64()), pa.array(fars, pa.int32()),
                 pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64())],
                ["doc_id", "item_id", "similarity", "distance", "start_byte", "end_byte"])

    return run


def _item_grams(batches):
    """The distinct shingles of every item, their words joined by spaces, which no word has."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            low = tokens.fold(np.frombuffer(text.encode(), np.uint8))
            _, _, begins, ends = tokens.words(low, np.array([0, len(low)]), tokens.LETTERS)
            out += {b" ".join(g) for g in _runs([low[b:e].tobytes() for b, e in zip(begins, ends, strict=True)])}
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["gram"])


def _rarity(items: DataFrame) -> tuple[Counter, int]:
    """The weights of the shingles that several items of the whole benchmark have, and the number of items.

    A shingle of one item weighs as much as one of none, so only the repeated ones are told.
    """
    n_items = items.count()
    often = items.select("text").mapInArrow(_item_grams, "gram binary").groupBy("gram").count().filter("count > 1")
    return Counter({tuple(bytes(r.gram).split(b" ")): math.log(1 + n_items / r["count"]) for r in often.toLocalIterator()}), n_items


def _item_blocks(items: DataFrame, block_bytes: int):
    """The items in blocks of bounded size, so that a benchmark of any length is searched in several passes."""
    ids, texts, held = [], [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text) + 64
        if held >= block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int | None = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold a benchmark item: (doc_id, item_id, similarity, distance, start_byte, end_byte), the best window of each pair.

    Words are runs of letters and digits without case. Windows have the word count of an item; a shorter document is a
    window as a whole. A fingerprint is the 64-bit SimHash of the window's five-word shingles (all words for shorter
    items), each voting with its rarity in the whole benchmark. Fingerprints are cut into radius + 1 blocks of bits, of
    which one at least agrees wherever the distance is within the radius, so the index finds all such pairs. They are
    verified: the similarity is the weighted Jaccard similarity of the shingles, with the same weights, whatever the
    blocks of items. Ties go to the smaller distance, then the earlier window.

    With the default radius about one in a hundred windows of similarity ``least`` itself is further away, more similar
    ones hardly ever; ``radius=None`` searches exactly instead, by rare shingles, with distances of 0.

    Null texts hold nothing, items without words are in no document, an empty table gives no rows. Null and repeated
    ids keep a row per row and item; repeated item rows count once. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), known().alias("text"))
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), known().alias("text")).distinct(), "items")
    rarity, n_items = _rarity(items)
    found = None
    for ids, texts in _item_blocks(items, block_bytes):
        part = rows.mapInArrow(
            _searcher(texts, ids, radius, least, rarity, n_items),
            "doc_id long, item_id long, similarity double, distance int, start_byte long, end_byte long")
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.filter("false").selectExpr(
            "doc_id", "CAST(NULL AS long) AS item_id", "CAST(NULL AS double) AS similarity", "CAST(NULL AS int) AS distance",
            "CAST(NULL AS long) AS start_byte", "CAST(NULL AS long) AS end_byte")
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose texts hold no benchmark item, with all their columns, whatever their names.

    Every row is judged by its own text, as ``find_leaks`` does it: rows without an id or with a shared one as well,
    equal texts alike. Null, empty and blank texts hold nothing and stay, repeated rows stay or go together, texts of
    any length are searched as a whole, an empty table stays empty.
    """
    key = unused(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(known()))
    named = keyed.select(F.col(key).alias("doc_id"), "text")
    leaks = staged(find_leaks(named, benchmark).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return keyed.join(checked(leaks, 16), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
