"""Removal of byte strings that already occur in an earlier document, by sorting suffixes of the places that can repeat.

Every string of LENGTH bytes is owned by one anchor: the position of the least hash of the GRAM-byte strings in it. Equal
strings own anchors of equal hash at equal distance, so only anchors whose hash occurs in several documents matter. Of
these the strings themselves are compared: equal surroundings of an anchor are one class, and the suffixes of
different classes are sorted deep-shallow to find the strings they share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm import tokens
from cueloom.llm.common import BROADCAST_BYTES, checked, known, staged

LENGTH = 50
GRAM = 25
SHALLOW = 16
BUCKET_BYTES = 16 << 20
HOT_CLASSES = 50_000
PART_ANCHORS = 1 << 19
_U = np.uint64


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, position, first window, last window, hash) of the anchors of texts: each owns a run of window starts."""
    n, span = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, _U)
    up, down = tokens.POWERS.to(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(tokens.VALUES[data] * up[:n], out=total[1:])
    value = tokens.mix((total[gram:] - total[:-gram]) * down[: n + 1 - gram])
    hashes, place, width = value, np.arange(len(value), dtype=np.int32), 1
    while width < span:
        step = min(width, span - width)
        right = value[step:] < value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    starts = np.arange(len(value))
    rows = np.searchsorted(offsets, starts, "right") - 1
    whole = starts + length <= offsets[rows + 1]
    starts, rows, place = starts[whole], rows[whole], place[whole]
    if not len(starts):
        return none, none, none, none, np.zeros(0, _U)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    at = place[first].astype(np.int64)
    return rows[first], at, starts[first], starts[last], hashes[at]


def _chunked(batch, column: int) -> Iterator[tuple]:
    for row, data, offsets in tokens.text_chunks(batch.column(column)):
        yield row, data, offsets, anchors(data, offsets)


def _emit(buckets: int):
    """Per part of a batch and bucket: the anchors' hashes, each once with the first document that has it, and how often others repeat it."""

    def parts(batches):
        for batch in batches:
            order, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, many = [], 0
            for row, _, _, (rows, _, _, _, hashes) in _chunked(batch, 2):
                held.append((hashes, order[row + rows], tag[row + rows]))
                many += len(hashes)
                if many >= PART_ANCHORS:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, many = [], 0
            if many:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def run(batches):
        for hashes, owners, tags in parts(batches):
            sort = np.lexsort((tags, owners, hashes))
            hashes, owners, tags = hashes[sort], owners[sort], tags[sort]
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]) | (tags[1:] != tags[:-1])
            hashes, owners, tags = hashes[fresh], owners[fresh], tags[fresh]
            lead = np.ones(len(hashes), bool)
            lead[1:] = hashes[1:] != hashes[:-1]
            many = np.diff(np.append(np.flatnonzero(lead), len(hashes)))
            twice = np.repeat(many > 1, many)
            bucket = (hashes % _U(buckets)).astype(np.int64)
            sort = np.lexsort((tags, owners, bucket))  # near-equal owners side by side: they compress
            edges = np.searchsorted(bucket[sort], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges))
            blobs = []
            for b in used.tolist():
                at = sort[edges[b] : edges[b + 1]]
                # What a part repeats is known to repeat; of it only the first document is compared with other parts.
                flag = twice[at].astype(np.uint8) + 2 * lead[at].astype(np.uint8)
                blobs.append(b"".join([owners[at].astype("<i8").tobytes(), hashes[at].astype("<u8").tobytes(), tags[at].astype("<i4").tobytes(), flag.tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """(document, tag of its text, hash) of a bucket where the hash occurs in several documents."""
    owners, hashes, tags, flags = [], [], [], []
    for blob in table.column("blob"):
        raw = blob.as_buffer()
        n = len(raw) // 21
        owners.append(np.frombuffer(raw, "<i8", n))
        hashes.append(np.frombuffer(raw, "<u8", n, 8 * n))
        tags.append(np.frombuffer(raw, "<i4", n, 16 * n))
        flags.append(np.frombuffer(raw, np.uint8, n, 20 * n))
    owners, hashes, tags, flags = np.concatenate(owners), np.concatenate(hashes), np.concatenate(tags), np.concatenate(flags)
    lead = flags >= 2
    sort = np.argsort(hashes, kind="stable")
    h = hashes[sort]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    known_twice = np.zeros(group[-1] + 1, bool)
    known_twice[group[(flags[sort] & 1) > 0]] = True
    low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    high = np.full(group[-1] + 1, np.iinfo(np.int64).min)
    ends = lead[sort]
    np.minimum.at(low, group[ends], owners[sort][ends])
    np.maximum.at(high, group[ends], owners[sort][ends])
    keep = (known_twice | (low != high))[group]
    return pa.table({"order": owners[sort][keep], "tag": tags[sort][keep], "hash": h[keep].view(np.int64)})


def _surroundings(batches):
    """Of the anchors named by ``hashes``: the bytes of all their windows."""
    for batch in batches:
        wanted = batch.column(3)
        edges = wanted.offsets.to_numpy()
        names = wanted.values.to_numpy()
        order, text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for row, data, offsets, (rows, at, first, last, hashes) in _chunked(batch, 2):
            n = len(offsets) - 1
            mine = names[edges[row] : edges[row + n]]
            holder = np.repeat(np.arange(n), np.diff(edges[row : row + n + 1]))
            named = lambda r, h: tokens.mix(h.view(_U) ^ tokens.mix(r.astype(_U)))
            hit = np.isin(named(rows, hashes), named(holder, mine))
            rows, at, first, last, hashes = rows[hit], at[hit], first[hit], last[hit], hashes[hit]
            begins, ends = first, last + LENGTH
            raw = data.tobytes()
            around = [raw[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            key = tokens.span_hash(tokens.VALUES[data], begins, ends).view(np.int64) ^ (at - first)
            columns = [order[row + rows], text[row + rows], first - offsets[rows], (last - first + 1) | ((at - first) << 8), hashes.view(np.int64), key]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], pa.array(around, pa.binary())],
                ["order", "text_key", "start", "windows", "hash", "key", "around"])


class BlindTrie:
    """A Patricia tree of equally long strings: nodes have the depth of a branching and its characters only.

    Inserting follows branching characters without looking at what lies between, compares with the one string found,
    and branches at their first difference. Its leaves in order are the sorted distinct strings.
    """

    def __init__(self) -> None:
        self.root = None

    def insert(self, string: bytes, member: int) -> None:
        if self.root is None:
            self.root = (None, string, [member])
            return
        node = self.root
        while node[0] is not None:
            depth, children = node
            node = children.get(string[depth]) or next(iter(children.values()))
        leaf = node[1]
        if leaf == string:
            node[2].append(member)
            return
        differ = int.from_bytes(leaf) ^ int.from_bytes(string)
        at = len(string) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] is not None and node[0] < at:
            above, node = node, node[1][string[node[0]]]
        new = (None, string, [member])
        if node[0] == at:
            node[1][string[at]] = new
            return
        branch = (at, {leaf[at]: node, string[at]: new})
        if above is None:
            self.root = branch
        else:
            above[1][string[above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] is None:
                yield node[2]
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]


def equal_suffixes(strings: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, class) of the rows of ``strings`` that another row of their group equals, in sorted order of the classes.

    Shallow part: multikey quicksort on eight characters at a time, all parts of a depth at once; rows that stand alone
    drop out. Deep part, where SHALLOW characters agree: two rows are compared, more go through a blind trie.
    """
    live, group = np.arange(len(strings)), groups
    for depth in range(0, SHALLOW, 8):
        key = np.ascontiguousarray(strings[live, depth : depth + 8]).view(">u8").ravel().astype(_U)
        sort = np.lexsort((key, group))
        live, key, group = live[sort], key[sort], group[sort]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(live)))
        group = np.repeat(np.arange(len(first)), many)
        keep = np.repeat(many > 1, many)
        live, group = live[keep], group[keep]
    if not len(live):
        return live, live
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    many = np.diff(np.append(first, len(live)))
    pairs = first[many == 2]
    same = pairs[(strings[live[pairs]] == strings[live[pairs + 1]]).all(axis=1)]
    members, classes = [live[same], live[same + 1]], [np.arange(len(same))] * 2
    named, more_members, more_classes = len(same), [], []
    for begin, count in zip(first[many > 2].tolist(), many[many > 2].tolist(), strict=True):
        trie = BlindTrie()
        for i in live[begin : begin + count].tolist():
            trie.insert(strings[i, SHALLOW:].tobytes(), i)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                more_members += leaf
                more_classes += [named] * len(leaf)
                named += 1
    return np.concatenate([*members, np.array(more_members, np.int64)]), np.concatenate([*classes, np.array(more_classes, np.int64)])


def _shared(table: pa.Table) -> pa.Table:
    """Of the classes of a bucket: a mask of the windows that a class of an earlier document has as well."""
    hashes = table.column("hash").to_numpy()
    low = table.column("low").to_numpy()
    windows = table.column("windows").to_numpy()
    around = table.column("around").combine_chunks() if isinstance(table.column("around"), pa.ChunkedArray) else table.column("around")
    masks = np.zeros(len(hashes), np.int64)
    data = np.frombuffer(around.buffers()[2], np.uint8)
    edges = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1].astype(np.int64)
    count, shift = windows & 255, windows >> 8
    order = np.argsort(hashes, kind="stable")
    cut = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    stops = np.append(cut[1:], len(order))
    begin = 0
    while begin < len(cut):
        # Groups of one hash, as many as make a piece of bounded size.
        upto = begin + 1
        while upto < len(cut) and stops[upto] - cut[begin] < 20_000:
            upto += 1
        own = order[cut[begin] : stops[upto - 1]]
        begin = upto
        who = np.repeat(own, count[own])
        turn = np.arange(len(who)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        _, group = np.unique(hashes[who], return_inverse=True)
        # Windows of one hash can only be equal at equal distance from the anchor.
        group = group * 64 + (shift[who] - turn)
        strings = data[(edges[who] + turn)[:, None] + np.arange(LENGTH)]
        members, classes = equal_suffixes(strings, group)
        if not len(members):
            continue
        least = np.full(classes.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes, low[who[members]])
        late = members[low[who[members]] > least[classes]]
        np.bitwise_or.at(masks, who[late], np.int64(1) << turn[late])
    return pa.table({"hash": hashes, "key": table.column("key"), "mask": masks})


def _merge(batches):
    """Removed windows of a text, given as (start, windows, mask), as the byte spans they cover."""
    for batch in batches:
        lists = batch.column(2)
        edges = lists.offsets.to_numpy()
        start, count, mask = (lists.values.field(k).to_numpy() for k in range(3))
        turn = np.arange(LENGTH - GRAM + 1)
        starts, ends, sizes = [], [], []
        for i in range(batch.num_rows):
            part = slice(edges[i], edges[i + 1])
            on = ((mask[part, None] >> turn) & 1).astype(bool) & (turn < (count[part, None] & 255))
            at = np.unique((start[part, None] + turn)[on])
            new = np.flatnonzero(np.append(True, at[1:] > at[:-1] + LENGTH)) if len(at) else np.zeros(0, np.int64)
            starts.append(at[new])
            ends.append(at[np.append(new[1:], len(at)) - 1] + LENGTH if len(at) else at)
            sizes.append(len(new))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())) for v in (starts, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["order", "text_key", "starts", "ends"])


def repeated_spans(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """(order, text_key, starts, ends): the byte spans of distinct ``texts`` (order, text_key, text) that texts of smaller order have."""
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(n_bytes / bucket_bytes))
    # Many rows can share an order, those without id above all: a tag of the text tells them apart.
    tagged = texts.withColumn("tag", F.pmod("text_key", F.lit(2**31 - 1)).cast("int"))
    found = (
        tagged.select("order", "tag", "text").mapInArrow(_emit(buckets), "bucket long, blob binary")
        .groupBy("bucket").applyInArrow(_repeated, "order long, tag int, hash long")
    )
    wanted = found.groupBy("order", "tag").agg(F.collect_list("hash").alias("hashes"))
    around = staged(
        tagged.join(wanted, ["order", "tag"]).select("order", "text_key", "text", "hashes")
        .mapInArrow(_surroundings, "order long, text_key long, start long, windows long, hash long, key long, around binary"), "suffix-around")
    # Equal surroundings are one class, known by two 64-bit hashes; its earliest document stands for it.
    classes = around.groupBy("hash", "key").agg(F.min("order").alias("low"), F.first("windows").alias("windows"), F.first("around").alias("around"))
    classes = staged(classes, "suffix-classes")
    sizes = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    hot = staged(sizes.filter(F.col("classes") > hot_classes).select("hash"), "suffix-hot")
    several = classes.join(sizes.filter(F.col("classes") <= hot_classes).select("hash"), "hash", "left_semi")
    masks = several.withColumn("bucket", F.pmod("hash", F.lit(buckets))).groupBy("bucket").applyInArrow(_shared, "hash long, key long, mask long").filter("mask <> 0")
    # An anchor with very many classes is split by its windows; equal strings meet after pre-aggregation.
    wide = classes.join(checked(hot, 8), "hash", "left_semi").select(
        "hash", "key", "low", (F.shiftright("windows", 8)).alias("shift"), F.explode(F.sequence(F.lit(0), (F.col("windows").bitwiseAND(255) - 1).cast("int"))).alias("turn"), "around",
    ).select("hash", "key", "low", "turn", F.expr(f"struct(shift - turn AS apart, substring(around, turn + 1, {LENGTH}) AS string)").alias("string"))
    least = wide.groupBy("hash", "string").agg(F.min("low").alias("least"), F.max("low").alias("most")).filter("least < most").select("hash", "string", "least")
    split = wide.join(least, ["hash", "string"]).filter("low > least").groupBy("hash", "key").agg(
        F.bit_or(F.expr("shiftleft(1L, turn)")).alias("mask"))
    masks = masks.unionByName(split)
    firsts = classes.select("hash", "key", "low")
    told = (
        around.select("order", "text_key", "start", "windows", "hash", "key").join(firsts, ["hash", "key"]).join(masks, ["hash", "key"], "left")
        .withColumn("mask", F.when(F.col("order") > F.col("low"), F.lit(-1).cast("long")).otherwise(F.coalesce("mask", F.lit(0).cast("long"))))
        .filter("mask <> 0")
    )
    lists = told.groupBy("order", "text_key").agg(F.collect_list(F.struct("start", "windows", "mask")).alias("removed"))
    return lists.mapInArrow(_merge, "order long, text_key long, starts array<long>, ends array<long>")


def _cut(batches):
    for batch in batches:
        texts, starts, ends, copies = (batch.column(i).to_pylist() for i in range(1, 5))
        rows = []
        for text, begin, end, copy in zip(texts, starts, ends, copies, strict=True):
            raw = text.encode()
            if copy and len(raw) >= LENGTH:
                begin, end = [0], [len(raw)]
            spans = list(zip(begin or [], end or [], strict=True))
            parts, at = [], 0
            for b, e in spans:
                parts.append(raw[at:b])
                at = e
            left = b"".join([*parts, raw[at:]])
            rows.append((len(raw), len(raw) - len(left), len(spans), left))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary()),
             pa.array([hashlib.sha256(x).hexdigest() for x in columns[3]], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot_classes: int = HOT_CLASSES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text without the bytes covered by a 50-byte string that also starts in a document of smaller doc_id.

    Texts are UTF-8 bytes, a null text is empty; strings don't cross documents and are judged on the input. Returns
    doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256, a row per row. Rows without an id count as
    later than all others and not as earlier than each other; rows that share an id are not earlier than each other
    either. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), known(text).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order"), F.xxhash64("text").alias("text_key"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # Of equal texts all but the earliest go whole; the earliest stands for them.
    same = rows.groupBy("digest").agg(F.min("order").alias("low"), F.max("order").alias("high")).filter("low < high").select("digest", "low")
    same = staged(same, "suffix-equal")
    late = staged(rows.select("order", "digest").join(checked(same, 48), "digest").filter("order > low").select("order", "digest").distinct(), "suffix-late")
    late = checked(late, 64)
    early = rows.join(late, ["order", "digest"], "left_anti").select("order", "text_key", "text")
    spans = staged(repeated_spans(early, bucket_bytes, hot_classes), "suffix-spans")
    n, n_spans = spans.agg(F.count(F.lit(1)), F.sum(F.size("starts"))).first()
    small = n * 64 + (n_spans or 0) * 16 <= BROADCAST_BYTES
    joined = rows.join(late.withColumn("copy", F.lit(True)), ["order", "digest"], "left").join(F.broadcast(spans) if small else spans, ["order", "text_key"], "left")
    return joined.select("doc_id", "text", "starts", "ends", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
