"""Ordered scans over keyed rows that stay balanced when one key is huge.

Running totals, previous/next row, islands and order-dependent folds all need the rows
of a key in order. Most keys fit one task, and then an ordinary window (or one sorted
pass) is the best plan. A key that holds a large share of all rows would pin that plan to
one task, so such keys are cut into ordered blocks:

* ``plan_layout`` counts rows per key (one map-side combined aggregate, one job) and, only if
  some key is hot, samples its order values to place the cuts. The number of hot keys and of
  cuts is bounded by the number of shuffle partitions, never by the data.
* ``scan`` evaluates each block on its own and adds what the earlier (or later) blocks of
  the key contribute, which is one small row per block.
* ``fold`` runs a step function over sorted rows. Every block is first summed up as a map from
  the state that enters it to the state that leaves it, all blocks at once; following these
  maps block by block gives every entry state, and then all blocks run. Results are exact
  whatever the cuts are.

Every row is kept: cuts only decide which task sees a row.
"""

from __future__ import annotations

import pickle
import weakref
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.session import hot_rows, task_rows

BLOCK = "_blk"
PLACE = "_place"
_SAMPLES_PER_BLOCK = 32
_HOT_KEYS_PER_PARTITION = 4


@dataclass
class Layout:
    """Key and order columns of a scan plus the cuts of its hot keys (usually none)."""

    keys: list[str]
    order: list[str]
    cuts: dict[tuple, list[tuple]] = field(default_factory=dict)
    key_types: list[T.DataType] = field(default_factory=list)
    order_types: list[T.DataType] = field(default_factory=list)
    #: Rows of all keys, as far as counted.
    rows: int = 0

    @property
    def split(self) -> bool:
        return bool(self.cuts)

    def on(self, keys: Sequence[str] | None = None, order: Sequence[str] | None = None) -> Layout:
        """Same cuts for derived rows whose columns have other names."""
        return Layout(
            list(keys or self.keys), list(order or self.order), self.cuts, self.key_types, self.order_types, self.rows
        )

    def partition(self) -> list[str]:
        return [*self.keys, BLOCK] if self.split else list(self.keys)

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the block number: how many cuts of the row's key are not after the row."""
        if not self.split:
            return df
        cut_type = T.ArrayType(
            T.StructType([T.StructField(f"o{i}", t) for i, t in enumerate(self.order_types)])
        )
        schema = T.StructType(
            [T.StructField(k, t) for k, t in zip(self.keys, self.key_types)]
            + [T.StructField("_cuts", cut_type)]
        )
        cuts = df.sparkSession.createDataFrame([(*k, c) for k, c in self.cuts.items()], schema)
        here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(self.order)])
        return (
            null_safe_join(df, F.broadcast(cuts), self.keys, "left")
            .withColumn(BLOCK, F.coalesce(_cuts_not_after(F.col("_cuts"), here), F.lit(0)))
            .drop("_cuts")
        )


def _in_one_job(df: DataFrame) -> list:
    """The rows of a small aggregate. Adaptive plans would run a job per exchange, with nothing to adapt here."""
    spark = df.sparkSession
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.collect()
    finally:
        spark.conf.set(name, before)


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys of which null is a value like others; the keys of ``df`` stay."""
    named = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
    return df.join(named, same, how).drop(*[f"_other_{k}" for k in keys])


def _cuts_not_after(cuts: Column, value: Column) -> Column:
    """Binary search inside an expression, so long cut lists cost log2 steps per row."""

    def halve(acc: Column, _step: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        inside = acc["lo"] < acc["hi"]
        right = inside & (F.get(cuts, middle) <= value)
        return F.struct(
            F.when(right, middle + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(inside & ~right, middle).otherwise(acc["hi"]).alias("hi"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + F.lit(1))).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    found = F.aggregate(steps, start, halve, lambda acc: acc["lo"])
    return F.when(cuts.isNotNull(), found)


def spread(df: DataFrame, part: Sequence[str], rows: int) -> DataFrame:
    """``df`` dealt by ``part`` to as many tasks as keep each at ``cueloom.taskRows``; as it is where one task may hold all rows.

    The number is always given, however many partitions the session has: adaptive plans put those together by their bytes,
    whatever rows that makes. It is never the session's, because a deal that equals what a join below asks for is left out
    of the plan, and the join's is put together.
    """
    spark = df.sparkSession
    needed, wave = -(-rows // task_rows(spark)), spark.sparkContext.defaultParallelism
    if needed <= 1:
        return df
    tasks = max(needed, wave)
    return df.repartition(tasks + wave if tasks == int(spark.conf.get("spark.sql.shuffle.partitions")) else tasks, *part)


# The rows of the largest key and of all keys that were counted for a table, as (keys, rows, rows of all).
_COUNTED: weakref.WeakKeyDictionary[DataFrame, tuple[list[str], int, int]] = weakref.WeakKeyDictionary()


def at_most(df: DataFrame, *of: DataFrame, times: int = 1, every: int = 1) -> DataFrame:
    """``df``, with the note that no key has more than ``times`` the rows that it has in ``of``, all together.

    Where these have been counted, ``plan_layout`` can tell of ``df`` without a job that no key is hot.
    ``every`` says that so many rows of a key, the last ones fewer, have become one.
    """
    counted = [_COUNTED.get(other) for other in of]
    if all(counted) and len({tuple(sorted(keys)) for keys, *_n in counted}) == 1:
        # Runs end with their key, so that all keys together may keep more than one row in ``every``.
        _COUNTED[df] = (counted[0][0], -(-times * sum(n for _keys, n, _all in counted) // every), times * sum(n for *_keys, n in counted))
    return df


def one_row_each(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether it has been counted that no key has more than one row."""
    counted = _COUNTED.get(df)
    return counted is not None and set(counted[0]) <= set(keys) and counted[1] <= 1


def plan_layout(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Layout:
    """Find keys too large for one task and where to cut them; one job at most where there are none."""
    spark = df.sparkSession
    keys, order = list(keys), list(order)
    counted = _COUNTED.get(df)
    if counted and set(counted[0]) <= set(keys) and counted[1] <= hot_rows(spark):
        return Layout(keys, order, rows=counted[2])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    summed = counts.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0)))
    [(most, rows)] = _in_one_job(summed)
    _COUNTED[df] = keys, most, rows
    layout = Layout(keys, order, rows=rows)
    if most <= hot_rows(spark):
        return layout
    largest = _in_one_job(counts.orderBy(F.desc("_n")).limit(_HOT_KEYS_PER_PARTITION * partitions))
    hot = [tuple(r) for r in largest if r[-1] > hot_rows(spark)]
    # The blocks of all hot keys come to no more than a few per partition.
    block_rows = max(hot_rows(spark), sum(r[-1] for r in hot) // (_HOT_KEYS_PER_PARTITION * partitions))
    hot = [r for r in hot if r[-1] > block_rows]
    if not hot:
        return layout
    fields = {f.name: f.dataType for f in df.schema.fields}
    layout.key_types = [fields[k] for k in keys]
    layout.order_types = [fields[c] for c in order]
    hot_schema = T.StructType(
        [T.StructField(k, t) for k, t in zip(keys, layout.key_types)] + [T.StructField("_n", T.LongType())]
    )
    hot_keys = spark.createDataFrame(hot, hot_schema).drop("_n")
    share = min(1.0, _SAMPLES_PER_BLOCK / block_rows)
    # The sample only places cuts; no result is computed from it.
    picked = (
        null_safe_join(df.select(*dict.fromkeys([*keys, *order])), F.broadcast(hot_keys), keys, "left_semi")
        .sample(fraction=share, seed=7)
        .collect()
    )
    drawn: dict[tuple, list[tuple]] = {row[:-1]: [] for row in hot}
    for row in picked:
        drawn[tuple(row[k] for k in keys)].append(tuple(row[c] for c in order))
    for row in hot:
        key, blocks = row[:-1], -(-row[-1] // block_rows)
        values = sorted(v for v in drawn[key] if None not in v)
        cuts = {values[len(values) * i // blocks] for i in range(1, blocks)} if values else set()
        if cuts:
            layout.cuts[key] = sorted(cuts)
    return layout


# ---------------------------------------------------------------------------- windows

Spec = tuple[str, "Column | None"]


def scan(df: DataFrame, layout: Layout, specs: dict[str, Spec]) -> DataFrame:
    """Add ordered per-key columns.

    ``specs`` maps a new column to ``(kind, value)``; kinds are
    ``max_before``, ``sum_before`` (exclusive prefixes), ``number`` (1-based position),
    ``prev``, ``next`` (neighbouring row's value), ``last_before`` (last non-null value
    before the row), ``count_all``, ``sum_all`` and ``max_all`` (whole key).
    """
    if not layout.split:
        plain = Window.partitionBy(*layout.keys)
        return at_most(spread(df, layout.keys, layout.rows).select("*", *[_local(kind, value, plain, layout.order).alias(name)
                                        for name, (kind, value) in specs.items()]), df)
    tagged = df if BLOCK in df.columns else layout.tag(df)
    block = Window.partitionBy(*layout.keys, BLOCK)
    local = spread(tagged, [*layout.keys, BLOCK], layout.rows).select(
        "*", *[_local(kind, value, block, layout.order, wrap=True).alias(f"_l_{name}")
               for name, (kind, value) in specs.items()]
    )
    carried = _carry(tagged, layout, specs)
    joined = null_safe_join(local, F.broadcast(carried), [*layout.keys, BLOCK], "left")
    kept = [F.col(c) for c in df.columns if c != BLOCK]
    return joined.select(*kept, *[_merged(kind, name).alias(name) for name, (kind, _v) in specs.items()])


def _local(kind: str, value: Column | None, base, order: list[str], wrap: bool = False) -> Column:
    ordered = base.orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "max_before":
        return F.max(value).over(before)
    if kind == "sum_before":
        return F.coalesce(F.sum(value).over(before), F.lit(0))
    if kind == "number":
        return F.row_number().over(ordered).cast("bigint")
    if kind == "last_before":
        return F.last(value, ignorenulls=True).over(before)
    if kind in ("prev", "next"):
        shift = F.lag if kind == "prev" else F.lead
        return shift(F.struct(value.alias("v"))).over(ordered) if wrap else shift(value).over(ordered)
    if kind == "count_all":
        return F.count(F.lit(1)).over(base)
    if kind == "max_all":
        return F.max(value).over(base)
    if kind == "sum_all":
        return F.sum(value).over(base)
    raise ValueError(f"unknown scan kind {kind}")


def _carry(tagged: DataFrame, layout: Layout, specs: dict[str, Spec]) -> DataFrame:
    """One row per block of a hot key: what the other blocks of the key contribute."""
    place = F.struct(*[F.col(c) for c in layout.order])
    per_block = {}
    for name, (kind, value) in specs.items():
        if kind in ("max_before", "max_all"):
            per_block[name] = F.max(value)
        elif kind in ("sum_before", "sum_all"):
            per_block[name] = F.sum(value)
        elif kind in ("number", "count_all"):
            per_block[name] = F.count(F.lit(1))
        elif kind == "last_before":
            per_block[name] = F.max_by(value, F.when(value.isNotNull(), place))
        elif kind == "prev":
            per_block[name] = F.max_by(F.struct(value.alias("v")), place)
        elif kind == "next":
            per_block[name] = F.min_by(F.struct(value.alias("v")), place)
    hot_schema = T.StructType([T.StructField(k, t) for k, t in zip(layout.keys, layout.key_types)])
    hot_keys = tagged.sparkSession.createDataFrame(list(layout.cuts), hot_schema)
    blocks = (
        null_safe_join(tagged, F.broadcast(hot_keys), layout.keys, "left_semi")
        .groupBy(*layout.keys, BLOCK)
        .agg(*[agg.alias(f"_b_{name}") for name, agg in per_block.items()])
    )
    of_key = Window.partitionBy(*layout.keys)
    by_block = of_key.orderBy(BLOCK)
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    after = by_block.rowsBetween(1, Window.unboundedFollowing)
    out = []
    for name, (kind, _value) in specs.items():
        col = F.col(f"_b_{name}")
        if kind == "max_before":
            got = F.max(col).over(before)
        elif kind in ("sum_before", "number"):
            got = F.sum(col).over(before)
        elif kind in ("prev", "last_before"):
            got = F.last(col, ignorenulls=True).over(before)
        elif kind == "next":
            got = F.first(col, ignorenulls=True).over(after)
        elif kind in ("count_all", "sum_all"):
            got = F.sum(col).over(of_key)
        else:
            got = F.max(col).over(of_key)
        out.append(got.alias(f"_c_{name}"))
    return blocks.select(*layout.keys, BLOCK, *out)


def _merged(kind: str, name: str) -> Column:
    local, carried = F.col(f"_l_{name}"), F.col(f"_c_{name}")
    if kind == "max_before":
        return F.greatest(local, carried)
    if kind in ("sum_before", "number"):
        return local + F.coalesce(carried, F.lit(0))
    if kind == "last_before":
        return F.coalesce(local, carried)
    if kind in ("prev", "next"):
        return F.coalesce(local, carried)["v"]
    return F.coalesce(carried, local)


def islands(df: DataFrame, layout: Layout, starts: Column, name: str) -> DataFrame:
    """Number runs of rows: ``starts`` is true on the first row of every run (1-based)."""
    flagged = df.withColumn("_start", F.when(starts, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return (
        scan(flagged, layout, {name: ("sum_before", F.col("_start"))})
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_start")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key.

    Equal values are first counted, then the two ranks around each quantile are picked by a
    running count. The built-in ``percentile`` would hold all distinct values of a key in one
    task, and interpolates with other rounding.
    """
    rows = at_most(df.where(F.col(value).isNotNull()), df)
    layout = plan_layout(rows, keys, [value])
    grouped = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = scan(grouped, layout, {"_below": ("sum_before", F.col("_n")), "_rows": ("sum_all", F.col("_n"))})
    picks = []
    for name, q in points.items():
        at = (F.col("_rows") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}_{name}"))
    picked = placed.groupBy(*keys).agg(F.max("_rows").alias("_rows"), *picks)
    out = []
    for name, q in points.items():
        at = (F.col("_rows") - 1) * F.lit(float(q))
        part = at - F.floor(at)
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        # Interpolated from the nearer end, so that rounding does not depend on the direction.
        out.append(F.when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part)).alias(name))
    return picked.select(*keys, *out)


# ------------------------------------------------------------------------------ folds

_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
    "string": pa.string(), "boolean": pa.bool_(),
}
Step = Callable[[object, tuple], tuple[object, tuple]]


def fold(
    df: DataFrame,
    layout: Layout,
    inputs: Sequence[str],
    step: Step,
    outputs: Sequence[tuple[str, str]],
    clustered: bool = False,
    summary: Callable[[], object] | None = None,
) -> DataFrame:
    """Add columns computed by ``step(state, values) -> (state, outputs)`` in key order.

    ``state`` is ``None`` on the first row of a key and must be hashable. The pass streams
    Arrow batches of sorted partitions, so no key is ever held in memory. ``summary`` makes
    what sums up a block of a hot key, by default ``Trajectories``.
    ``clustered`` says that ``df`` comes from ``scan`` with the same layout, whose window has
    already brought the rows of a key together, so a second shuffle is left out.
    """
    inputs, outputs = list(inputs), list(outputs)
    schema = T.StructType(
        [f for f in df.schema.fields if f.name != BLOCK]
        + T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in outputs)).fields
    )
    part = layout.partition()
    tagged = layout.tag(df)
    entries = _settle(tagged, layout, inputs, step, summary or (lambda: Trajectories(step))) if layout.split else {}
    if clustered and not layout.split:
        ordered = tagged.sortWithinPartitions(*part, *layout.order)
    else:
        ordered = _in_order(spread(tagged, part, layout.rows), part, layout.order)
    run = _row_runner(layout.keys, layout.split, inputs, step, outputs, entries)
    return ordered.mapInArrow(run, schema)


def _in_order(rows: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """The rows of a key together in one partition and in order, with their number in ``PLACE``.

    The number is there for its window: a ``repartition`` above a join on the same keys is left out of the plan, and when
    the join then becomes a broadcast while running, its rows are read where they lie, a key's in several tasks. What a
    window needs holds whatever becomes of the join.
    """
    number = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return rows.withColumn(PLACE, number).sortWithinPartitions(*part, *order)


def _row_runner(keys, split, inputs, step, outputs, entries):
    names = [n for n, _t in outputs]
    types = [_ARROW[t] for _n, t in outputs]

    def run(batches: Iterable[pa.RecordBatch]):
        current, state = None, None
        for batch in batches:
            ids = list(zip(*[batch.column(k).to_pylist() for k in [*keys, *([BLOCK] if split else [])]]))
            values = zip(*[batch.column(c).to_pylist() for c in inputs])
            made = []
            for ident, row in zip(ids, values):
                if ident != current:
                    current, state = ident, entries.get(ident)
                state, out = step(state, row)
                made.append(out)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made), types)] if made else [
                pa.array([], t) for t in types]
            kept = [i for i, n in enumerate(batch.schema.names) if n not in (BLOCK, PLACE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + columns,
                names=[batch.schema.names[i] for i in kept] + names,
            )

    return run


#: What ``leave`` of a block's summary returns where only running the block can tell.
UNKNOWN = "unknown"
_HEAD = 256


class Trajectories:
    """The map of a block for any fold: runs that start afresh at each of its first rows, joined as they fall into step.

    A state that enters the block is carried on by ``leave`` over the kept first rows until it is what a fresh start at
    some row would be; from there on the two are one. Runs of the same state are carried on as one, so there are about
    as many as a group has rows.
    """

    def __init__(self, step: Step, head: int = _HEAD) -> None:
        self.step, self.most, self.head = step, head, []
        self.live: dict[object, list[int]] = {}
        self.whole = True

    def feed(self, row: tuple) -> None:
        live: dict[object, list[int]] = {}
        for state, starts in self.live.items():
            after = self.step(state, row)[0]
            if after in live:
                live[after] += starts
            else:
                live[after] = starts
        if len(self.head) < self.most:
            live.setdefault(self.step(None, row)[0], []).append(len(self.head))
            self.head.append(row)
        else:
            self.whole = False
        self.live = live

    def closed(self) -> tuple:
        """What the driver needs: the first rows, where a run that starts at each of them ends, and whether these are all rows."""
        exits = {start: state for state, starts in self.live.items() for start in starts}
        return self.head, [exits[i] for i in range(len(self.head))], self.whole

    def leave(self, closed: tuple, state: object) -> object:
        head, exits, whole = closed
        for row, after in zip(head, exits):
            state, fresh = self.step(state, row)[0], self.step(None, row)[0]
            if state == fresh:
                return after
        return state if whole else UNKNOWN


def _settle(tagged: DataFrame, layout: Layout, inputs, step, summary) -> dict[tuple, object]:
    """Entry state of every block of every hot key.

    One job sums up all blocks; their number is bounded by the layout and a summary is small. Where a summary can't tell
    what leaves a block, that block is run by itself, once for all keys that wait for one.
    """
    spark = tagged.sparkSession
    key_fields = [T.StructField(k, t) for k, t in zip(layout.keys, layout.key_types)]
    needed = list(dict.fromkeys([*layout.keys, BLOCK, *layout.order, *inputs]))
    hot = null_safe_join(
        tagged.select(*needed), F.broadcast(spark.createDataFrame(list(layout.cuts), T.StructType(key_fields))), layout.keys, "left_semi")
    part_schema = T.StructType([*key_fields, T.StructField(BLOCK, T.IntegerType())])
    part = [*layout.keys, BLOCK]

    def told(rows: DataFrame, run) -> dict[tuple, object]:
        out = _in_order(spread(rows, part, layout.rows), part, layout.order).mapInArrow(run, T.StructType([*part_schema.fields, T.StructField("_told", T.BinaryType())]))
        return {tuple(r[:-1]): pickle.loads(r[-1]) for r in _in_one_job(out)}

    blocks = told(hot, _block_runner(layout.keys, inputs, lambda _ident: summary(), lambda s, row: (s.feed(row), s)[1], lambda s: s.closed()))
    asked = summary()
    entries: dict[tuple, object] = {}
    exits: dict[tuple, object] = {}
    waiting = {key: sorted(b[-1] for b in blocks if b[:-1] == key) for key in {b[:-1] for b in blocks}}
    while waiting:
        stuck = []
        for key, numbers in list(waiting.items()):
            while numbers:
                ident = (*key, numbers[0])
                if ident not in exits:
                    entries.setdefault(ident, None)
                    left = asked.leave(blocks[ident], entries[ident])
                    if isinstance(left, str) and left == UNKNOWN:
                        stuck.append(ident)
                        break
                    exits[ident] = left
                numbers.pop(0)
                if numbers:
                    entries[(*key, numbers[0])] = exits[ident]
            if not numbers:
                del waiting[key]
        if stuck:
            again = null_safe_join(hot, F.broadcast(spark.createDataFrame(stuck, part_schema)), part, "left_semi")
            exits |= told(again, _block_runner(layout.keys, inputs, entries.get, lambda state, row: step(state, row)[0], lambda state: state))
    return entries


def _block_runner(keys, inputs, begin, feed, close):
    """Runs every block from ``begin(block)`` over its rows and tells ``close`` of what came out."""

    def run(batches: Iterable[pa.RecordBatch]):
        current, held, made, fields = None, None, [], []
        for batch in batches:
            fields = [batch.schema.field(k) for k in [*keys, BLOCK]]
            ids = zip(*[batch.column(k).to_pylist() for k in [*keys, BLOCK]])
            values = zip(*[batch.column(c).to_pylist() for c in inputs])
            for ident, row in zip(ids, values):
                if ident != current:
                    if current is not None:
                        made.append((*current, pickle.dumps(close(held))))
                    current, held = ident, begin(ident)
                held = feed(held, row)
        if current is not None:
            made.append((*current, pickle.dumps(close(held))))
            schema = pa.schema([*fields, pa.field("_told", pa.binary())])
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*made), schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run
