"""Exact Jaccard links between documents over word n-grams, and their components.

The universe of shingles is cut into segments by hash. Two sets that link differ in few shingles, so some segments
agree up to a small difference (pigeonhole). Segments per size band, one-deletion neighbourhoods and the segments a
set may leave out are chosen by cost; what shares a segment is verified on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm import tokens
from cueloom.llm.common import checked, known, staged

#: Shingles in a block of sets that are compared as wholes.
BLOCK_GRAMS = 1 << 16
_U = np.uint64


@dataclass(frozen=True)
class Band:
    """Sets of low..high shingles: ``exact`` segments must agree, ``loose`` ones may differ in one shingle; ``spare`` may be left out."""

    low: int
    high: int
    exact: int
    loose: int
    spare: int


def _allocate(low: int, high: int, differ: int) -> Band:
    """The cheapest segments with exact + 2 * loose > differ + spare, by keys written and by sets expected to share small segments."""
    best = None
    for loose in {0, 1, 2, (differ + 2) // 2, *range(0, min(differ + 2, 12) // 2 + 1)}:
        # Thin segments are shared by many sets; as many as are to be expected can be left out.
        thin = 0 if loose else 1 + int((differ + 1) * (0.03 + 1.5 * math.exp(-low / (differ + 1))))
        for spare in {0, thin}:
            exact = max(0, differ + 1 + spare - 2 * loose)
            size = low / (exact + loose)
            crowded = 0.0 if exact + loose == 1 else 20 * math.exp(-size) * (1 + size)
            cost = exact * (1 + crowded * (0.3 if spare else 1)) + loose * (1 + size + crowded)
            if best is None or cost < best[0]:
                best = (cost, Band(low, high, exact, loose, spare))
    return best[1]


def bands(part: int, whole: int, largest: int) -> list[Band]:
    """Size bands for similarity part/whole. Linked sets lie in one band or in neighbouring ones."""
    out, low = [], 1
    while low <= largest:
        high = low * whole // part
        other = high * whole // part
        out.append(_allocate(low, high, (high + other) * (whole - part) // (whole + part)))
        low = high + 1
    return out


def _lower_bound(sizes: np.ndarray, part: int, whole: int) -> np.ndarray:
    return (sizes * part + whole - 1) // whole


def segment_keys(grams: np.ndarray, rows: np.ndarray, n_rows: int, plan: list[Band], part: int, whole: int):
    """(row, key, probe, spare) of all sets: in their own band, and as ``probe`` in the band below if a partner may lie there."""
    sizes = np.bincount(rows, minlength=n_rows)
    lows = np.array([b.low for b in plan])
    exact, loose, spare = (np.array([getattr(b, k) for b in plan]) for k in ("exact", "loose", "spare"))
    own = np.searchsorted(lows, sizes, "right") - 1
    for probe in (False, True):
        band = own - probe
        use = (sizes > 0) & (band >= 0)
        if probe:
            use &= _lower_bound(sizes, part, whole) < lows[np.maximum(own, 0)]
        many = np.where(use, (exact + loose)[band], 0)
        base = np.concatenate([[0], np.cumsum(many)])
        taken = use[rows]
        tok, row = grams[taken], rows[taken]
        salt = tokens.mix(band[row].astype(_U) + _U(0x51ED27))
        seg = ((tokens.mix(tok ^ salt) >> _U(32)) * many[row].astype(_U) >> _U(32)).astype(np.int64)
        name = tokens.mix(tok + _U(0x2545F4914F6CDD1D))
        sums = np.zeros(base[-1], _U)
        np.add.at(sums, base[row] + seg, name)
        owner = np.repeat(np.arange(n_rows), many)
        place = np.arange(base[-1]) - base[owner]
        where = tokens.mix((band[owner].astype(_U) << _U(40)) + place.astype(_U))
        keys = [tokens.mix(sums + where)]
        owners = [owner]
        dropped = seg < loose[band[row]]
        if dropped.any():
            at = base[row[dropped]] + seg[dropped]
            keys.append(tokens.mix(sums[at] - name[dropped] + where[at]))
            owners.append(row[dropped])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        yield owners, keys.view(np.int64), probe, spare[band[owners]]


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for row, data, offsets in tokens.text_chunks(column):
        hashes, owner, _, _ = tokens.words(tokens.LOWER[data], offsets, tokens.PLAIN)
        grams, rows = tokens.shingle_sets(hashes, owner, n)
        yield row, len(offsets) - 1, grams, rows


def _sizer(n: int):
    def run(batches):
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for row, count, _, rows in _sets(batch.column(2), n):
                sizes[row : row + count] = np.bincount(rows, minlength=count)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes)], ["doc_id", "digest", "n_shingles"])

    return run


def _emitter(n: int, part: int, whole: int):
    plan = bands(part, whole, 1 << 31)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, count, grams, rows in _sets(batch.column(1), n):
                for owner, keys, probe, spare in segment_keys(grams, rows, count, plan, part, whole):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row + owner]), pa.array(keys), pa.array(np.full(len(keys), probe)), pa.array(spare.astype(np.int32))],
                        ["node", "key", "probe", "spare"])

    return run


def _lister(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, count, grams, rows in _sets(batch.column(1), n):
                sizes = np.bincount(rows, minlength=count)
                edges = np.concatenate([[0], np.cumsum(sizes)]) * 8
                raw = grams.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row : row + count]), pa.array(sizes), pa.array([raw[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())],
                    ["node", "size", "grams"])

    return run


def _block(body: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sets = [np.frombuffer(x["grams"], _U) for x in body]
    sizes = np.array([len(x) for x in sets])
    return np.array([x["node"] for x in body]), np.array([x["label"] for x in body]), sizes, np.concatenate(sets)


def _comparer(part: int, whole: int):
    """Links between two blocks that join different components, as few as join them: one matrix product gives all overlaps."""

    def run(batches):
        for batch in batches:
            a_out, b_out = [], []
            for pair in range(batch.num_rows):
                (a, la, sa, ga), (b, lb, sb, gb) = (_block(batch.column(k)[pair].as_py()) for k in (0, 1))
                common = np.intersect1d(ga, gb)
                planes = []
                for sizes, grams in ((sa, ga), (sb, gb)):
                    at = np.minimum(np.searchsorted(common, grams), max(0, len(common) - 1))
                    hit = common[at] == grams if len(common) else np.zeros(len(grams), bool)
                    plane = np.zeros((len(sizes), len(common)), np.float32)
                    plane[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
                    planes.append(plane)
                shared = (planes[0] @ planes[1].T).astype(np.int64)
                linked = (shared > 0) & (whole * shared >= part * (sa[:, None] + sb[None] - shared)) & (la[:, None] != lb[None])
                up: dict = {}

                def root(x):
                    while up.get(x, x) != x:
                        x = up[x]
                    return x

                for i, j in zip(*[x.tolist() for x in np.nonzero(linked)], strict=True):
                    x, y = root(int(la[i])), root(int(lb[j]))
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        a_out.append(int(min(a[i], b[j])))
                        b_out.append(int(max(a[i], b[j])))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def _grams(text: str, n: int) -> frozenset:
    # Bytes are lowered in A-Z only and split at the six blanks of the contract.
    w = text.encode().lower().split()
    return frozenset(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def _verifier(n: int, part: int, whole: int):
    def run(batches):
        last, held = None, frozenset()
        for batch in batches:
            keep = []
            for i, (a, one, other) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if last != (a, one):
                    last, held = (a, one), _grams(one, n)
                second = _grams(other, n)
                shared = len(held & second)
                if shared and whole * shared >= part * (len(held) + len(second) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node it is connected with. Large and small stars in turn."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        now = staged(small.filter("u <> v").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == mark:
            break
        mark = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def link_components(
    docs: DataFrame, n: int = 4, part: int = 85, whole: int = 100, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Components of the links whole * |A & B| >= part * |A | B| between the n-word shingle sets of the texts.

    Words are runs without white space with A-Z lowered; a text of fewer than n words has its whole sequence as its
    one shingle. Returns a row per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).
    Null and empty texts have no shingles and link with nothing. Rows that share an id are one document that links by
    any of its texts; rows without an id link with nothing and have no component. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), known(text).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    sized = staged(
        rows.select("doc_id", digest.alias("digest"), "text").mapInArrow(_sizer(n), "doc_id long, digest binary, n_shingles long"), "jaccard-sizes")
    live = sized.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal texts are one node, named by their smallest id.
    classes = live.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    shared = staged(classes.filter("copies > 1").select("digest", "node"), "jaccard-copies")
    member = sized.join(checked(shared, 64), "digest", "left").select(
        "doc_id", "n_shingles", "digest", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")).alias("node"))
    member = staged(member, "jaccard-members")
    copies = staged(member.filter("node <> doc_id").select("doc_id", "digest").distinct(), "jaccard-repeats")
    own = rows.filter("doc_id IS NOT NULL").withColumn("digest", digest).join(checked(copies, 64), ["doc_id", "digest"], "left_anti").select(
        F.col("doc_id").alias("node"), "text")

    # Keys that several nodes share, and how many share each.
    per_key = Window.partitionBy("key")
    common = (
        own.mapInArrow(_emitter(n, part, whole), "node long, key long, probe boolean, spare int")
        .withColumns({"first": F.min("node").over(per_key), "last": F.max("node").over(per_key), "sharers": F.count(F.lit(1)).over(per_key)})
        .filter("first <> last").select("node", "key", "probe", "spare", "sharers")
    )
    # Of its keys in a band a set leaves out the ``spare`` that most sets share. The order is the same for all sets, so
    # of the spare + 1 keys that linked sets have in common at least, both keep the strongest.
    by_weight = Window.partitionBy("node", "probe").orderBy(F.desc("sharers"), "key")
    kept = staged(common.withColumn("weak", F.row_number().over(by_weight)).filter("weak > spare").select("key", "node").distinct(), "jaccard-keys")
    in_key = Window.partitionBy("key").orderBy("node")
    kept = staged(kept.withColumn("rank", F.row_number().over(in_key)), "jaccard-ranked")
    involved = staged(kept.select("node").distinct(), "jaccard-involved")
    texts = staged(own.join(checked(involved, 16), "node", "left_semi"), "jaccard-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        wide = (
            pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
            .select("a", "b", "one", "other")
        )
        return wide.mapInArrow(_verifier(n, part, whole), "a long, b long")

    # Several texts under one id tie the components of these texts together.
    ties = member.filter("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).join(
        member.filter("node = doc_id AND n_shingles > 0").select(F.col("doc_id").alias("b")).distinct(), "b", "left_semi").select("a", "b").union(
        member.filter("node <> doc_id").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("a", "b"))
    # First every node of a key is verified against the key's first one.
    first = kept.filter("rank = 1").select("key", F.col("node").alias("a"))
    links = staged(verified(kept.filter("rank > 1").join(first, "key").select("a", F.col("node").alias("b")).distinct()).union(ties), "jaccard-links")
    labels = staged(components(links), "jaccard-labels")
    # Links still missing join two components that share a key. Nodes of such keys that hang together are a cluster;
    # its nodes in order of size make blocks of bounded volume, and blocks of possible sizes are compared as wholes.
    told = kept.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    spread = told.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("node").alias("lead")).filter("x <> y").select("key", "lead")
    opened = staged(told.join(spread, "key").select("node", "label", "lead").distinct(), "jaccard-open")
    clusters = staged(components(opened.select(F.col("node").alias("a"), F.col("lead").alias("b"))), "jaccard-clusters").select("node", F.col("label").alias("cluster"))
    nodes = staged(opened.select("node", "label").distinct(), "jaccard-nodes")
    grams = texts.join(checked(nodes.select("node"), 16), "node", "left_semi").select("node", "text").mapInArrow(_lister(n), "node long, size long, grams binary")
    grams = staged(grams, "jaccard-grams")
    by_size = Window.partitionBy("cluster").orderBy("size", "node")
    placed = nodes.join(clusters, "node").join(grams.select("node", "size"), "node").withColumn(
        "block", F.floor(F.sum("size").over(by_size) / BLOCK_GRAMS))
    placed = staged(placed, "jaccard-placed")
    frame = placed.groupBy("cluster", "block").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.min("label").alias("x"), F.max("label").alias("y"))
    later = frame.select("cluster", F.col("block").alias("other"), F.col("least").alias("least2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    meet = frame.join(later, "cluster").filter(
        f"block <= other AND {whole} * most >= {part} * least2 AND NOT (x = y AND x2 = y2 AND x = x2)").select("cluster", "block", "other")
    bodies = staged(
        placed.join(grams.select("node", "grams"), "node").groupBy("cluster", "block").agg(F.collect_list(F.struct("node", "label", "grams")).alias("body")),
        "jaccard-blocks")
    wide = meet.join(bodies, ["cluster", "block"]).join(
        bodies.select("cluster", F.col("block").alias("other"), F.col("body").alias("body2")), ["cluster", "other"]).select("body", "body2")
    # A row holds two whole blocks, so only a few of them go to Python at once.
    close = staged(wide.mapInArrow(_comparer(part, whole), "a long, b long").distinct(), "jaccard-close", batch_rows=4)
    more = staged(verified(close), "jaccard-links")
    if not more.isEmpty():
        labels = staged(components(links.union(more)), "jaccard-labels")
    return member.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The table without near copies: of every component the row with the smallest doc_id stays.

    Rows without shingles or id stay, rows repeated whole stay once. Of several rows with the smallest id one stays.
    """
    found = link_components(docs, n, part, whole)
    drop = staged(found.filter("component_id <> doc_id").select("doc_id").distinct(), "jaccard-drop")
    rest = docs.join(checked(drop, 16), "doc_id", "left_anti")
    twice = staged(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "jaccard-twice")
    if twice.isEmpty():
        return rest
    alone = rest.join(checked(twice, 16), "doc_id", "left_anti")
    return alone.unionByName(rest.join(checked(twice, 16), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
