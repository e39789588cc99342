"""A Merkle manifest of a table and proofs of its rows, by a recursive query that climbs from every leaf to the root.

Every group of rows is a tree; its leaves are the rows' digests in ascending order of their keys, and ``FAN``
consecutive nodes have one parent. The trees' roots are the leaves of the top tree. Built levels are stored as node
rows: a row is a node with the ``STRIDE`` levels below it and names the row above, so that a climb of many levels
takes few steps. In a stored level the digests stand one after the other, so that a node's siblings are a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import ranked, staged

FAN = 3
STRIDE = 6
#: Rows that meet one stored node in a join; a node above more leaves is stored several times.
CROWD = 1024
TOP = -1


def digest(fields: list[Column]) -> Column:
    """Hexadecimal SHA-256 of fields, each as its number of bytes, a colon and its value, or ``-`` for null."""

    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(told(f) for f in fields)).cast("binary"), 256)


def _height(n: Column, fan: int) -> Column:
    """Levels above n leaves until one node remains."""
    powers = [fan**k for k in range(63) if fan**k < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < n))


def _nodes(leaves: DataFrame, fan: int, stride: int, name: str) -> DataFrame:
    """Node rows (tree, base, block, climb, levels, top, below, last) of trees whose leaves are (tree, position, height, digest, below).

    ``below`` counts the documents below a node; ``levels`` are the digests at ``base`` and the levels above, ``climb``
    levels in all, ``top`` the digest above them; ``last`` tells the root of its tree.
    """
    wide = fan**stride
    hashed = f"sha2(lower(hex(substring(element_at(built, -1), {32 * fan} * r + 1, {32 * fan}))) , 256)"
    runs = f"sequence(0L, octet_length(element_at(built, -1)) div {32 * fan} - IF(octet_length(element_at(built, -1)) % {32 * fan} = 0, 1, 0))"
    levels = f"aggregate(sequence(0, climb), array(low), (built, s) -> IF(s = 0, built, concat(built, array(unhex(array_join(transform({runs}, r -> {hashed}), ''))))))"
    rows, base, found = leaves, 0, []
    while True:
        blocks = rows.groupBy("tree", "height", F.expr(f"position div {wide}").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("position", "digest"))).alias("members"), F.sum("below").alias("below"))
        built = blocks.withColumn("base", F.lit(base)).withColumn("climb", F.least(F.lit(stride), F.col("height") - base)).withColumn(
            "low", F.unhex(F.array_join(F.transform("members", lambda m: F.hex(m["digest"])), "")))
        built = built.withColumn("levels", F.expr(levels)).select(
            "tree", "base", "block", "climb", "levels", F.element_at("levels", -1).alias("top"), "below", "height", (F.col("height") <= base + stride).alias("last"))
        built = staged(built, f"{name}-{base}")
        found.append(built)
        base += stride
        above = built.filter(~F.col("last"))
        if above.isEmpty():
            break
        rows = above.select("tree", F.col("block").alias("position"), "height", F.col("top").alias("digest"), "below")
    nodes = found[0]
    for level in found[1:]:
        nodes = nodes.unionByName(level)
    return nodes


CLIMB = """
WITH RECURSIVE climb(id, place, leaf, tree, base, block, slot, salt, folded, siblings, subroot, root) MAX RECURSION LEVEL 100 AS (
  SELECT id, place, leaf, tree, base, block, slot, salt, folded, X'' AS siblings, CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM {leaves}
  UNION ALL
  SELECT id, place, leaf, up_tree, up_base, up_block, up_slot, CAST(pmod(place, up_salts) AS INT), path.folded,
    -- At the root the siblings have all been met: their digest takes their place.
    IF(up_tree IS NULL, unhex(sha2(lower(hex(path.siblings)), 256)), path.siblings),
    coalesce(subroot, IF(last, top, NULL)), IF(up_tree IS NULL, top, NULL)
  FROM (
    SELECT c.id, c.place, c.leaf, c.subroot, n.last, n.top, n.up_tree, n.up_base, n.up_block, n.up_slot, n.up_salts,
      aggregate(slice(n.levels, 1, n.climb), named_struct('folded', c.folded, 'siblings', c.siblings, 'slot', c.slot),
        (at, level) -> named_struct(
          'folded', unhex(sha2(lower(hex(concat(
            substring(level, {run} * (at.slot div {fan}) + 1, 32 * (at.slot % {fan})), at.folded,
            substring(level, 32 * at.slot + 33, {run} - 32 - 32 * (at.slot % {fan}))))), 256)),
          'siblings', concat(at.siblings,
            substring(level, {run} * (at.slot div {fan}) + 1, 32 * (at.slot % {fan})),
            substring(level, 32 * at.slot + 33, {run} - 32 - 32 * (at.slot % {fan}))),
          'slot', CAST(at.slot div {fan} AS INT))) AS path
    FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.base = n.base AND c.block = n.block AND c.salt = n.salt))
SELECT id, leaf, subroot, root, siblings AS proof, folded FROM climb WHERE root IS NOT NULL
"""


def proofs(
    table: DataFrame, fields: list[str], key: str, group: str, changed: dict[str, Column] | None = None,
    fan: int = FAN, stride: int = STRIDE, crowd: int = CROWD,
) -> DataFrame:
    """Every row's leaf, its tree's root, the root of all, its proof and the root that its ``changed`` form leads to.

    A leaf is the ``digest`` of the row's ``fields``; ``changed`` gives some of them another value for the form that is
    checked against the manifest. Rows of a group ascend by ``key``, null first, ties by digest; groups ascend by their
    value as bytes, null first. Returns binary id, leaf, subroot, root, proof, folded and boolean ``verified``; the proof
    is the SHA-256 of the siblings' digests as text, level by level, left to right.

    Null fields and empty texts have digests of their own, repeated rows are leaves of their own, an empty table gives
    no rows. Other columns are not read. Texts of any length are hashed in place; only digests are shuffled. A group of
    any size is dealt by ranges, and a node above many leaves is stored once per ``crowd`` of them, so that no task gets
    a whole tree.
    """
    spark = table.sparkSession
    other = digest([(changed or {}).get(f, F.col(f)) for f in fields])
    rows = table.select(
        F.col(key).alias("id"), F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("group"),
        F.unhex(digest([F.col(f) for f in fields])).alias("leaf"), F.unhex(other).alias("folded"))
    places = ranked(rows, ["group"], ["id", "leaf"], "leaves")
    sizes = staged(places.groupBy("group").agg(F.count("*").alias("n")), "groups")
    trees = staged(ranked(sizes, [], ["group"], "trees", "tree").withColumn("height", _height(F.col("n"), fan)), "trees")
    leaves = staged(places.join(trees, "group").select("id", "tree", "position", "height", "leaf", "folded"), "places")
    low = _nodes(leaves.select("tree", "position", "height", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("below")), fan, stride, "nodes")
    height = _height(F.lit(trees.count()), fan)
    roots = low.filter("last").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("position"), height.alias("height"), F.col("top").alias("digest"), "below")
    high = _nodes(roots, fan, stride, "top")
    wide = fan**stride
    # The row above: the next block of the tree, or from a tree's root the top tree.
    up = low.unionByName(high).withColumn("up", F.expr(f"""CASE
        WHEN NOT last THEN named_struct('tree', tree, 'base', base + {stride}, 'block', block div {wide}, 'slot', CAST(block % {wide} AS INT))
        WHEN tree <> {TOP} THEN named_struct('tree', CAST({TOP} AS BIGINT), 'base', 0, 'block', tree div {wide}, 'slot', CAST(tree % {wide} AS INT)) END"""))
    crowds = F.ceil(F.col("below") / crowd).cast("int")
    above = up.select(F.struct("tree", "base", "block").alias("upper"), crowds.alias("up_salts"))
    nodes = up.withColumn("upper", F.expr("named_struct('tree', up.tree, 'base', up.base, 'block', up.block)")).join(above, "upper", "left").select(
        "tree", "base", "block", "climb", "levels", "top", "last", F.col("up.tree").alias("up_tree"), F.col("up.base").alias("up_base"),
        F.col("up.block").alias("up_block"), F.col("up.slot").alias("up_slot"), "up_salts", F.explode(F.sequence(F.lit(0), crowds - 1)).alias("salt"))
    first = leaves.select(
        "id", F.col("position").alias("place"), "leaf", "tree", F.lit(0).alias("base"), F.expr(f"position div {wide}").alias("block"),
        F.expr(f"CAST(position % {wide} AS INT)").alias("slot"), F.lit(0).alias("salt"), "folded")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        climbed = spark.sql(CLIMB.format(leaves="{leaves}", nodes="{nodes}", run=32 * fan, fan=fan), leaves=first, nodes=staged(nodes, "manifest"))
        climbed = staged(climbed, "proofs")
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)
    return climbed.withColumn("verified", F.col("folded") == F.col("root"))
