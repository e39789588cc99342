"""Secret scanning over a ledger of content-addressed blobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import checked, known, staged, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` is the shortest accepted length of group ``measured``. A new version scans all blobs anew."""

    kind: str
    pattern: str
    measured: int
    least: int
    version: int = 1


# The kinds of secrets in their order, then one more kind of this library.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
RULES = (*BASE_RULES, Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1))

# What redaction removes: a whole private key, from BEGIN to the END line, or to the last line or long run of base64
# where END is missing. The ledger's rule tells the place of a key by its BEGIN line only.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    r"(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])*+(?:[A-Z][A-Za-z]*+-[A-Za-z]++:[^\n]*+|[A-Za-z0-9+/]{20,}+={0,2}+|(?<=\n)[A-Za-z0-9+/]++={0,2}+(?=[\x20\t\r]*+(?:\n|\Z))))*+)"
)
KEY_RULES = (*BASE_RULES, Rule("pem", PEM, 0, 1, 2))


SPAN = "struct<start:int,place:int,kind:string,end:int,start_byte:int,end_byte:int>"
#: Rows of an array that are gone through before what they gave is put aside.
STRETCH = 512


def carried(rows: Column, step: Callable[[Column, Column], tuple[Column, Column, Column, Column]], kind: str) -> Column:
    """(at, at_byte, found): positions carried along an array, and what ``step(state, row) -> (at, at_byte, keep, item)`` found.

    What is found is appended to a short array, and full ones to an array of arrays, so that the work grows with the
    number of rows and not with its square.
    """
    none, many = (F.expr(f"CAST(array() AS {t})") for t in (f"array<{kind}>", f"array<array<{kind}>>"))

    def inner(state: Column, row: Column) -> Column:
        at, at_byte, keep, item = step(state, row)
        return F.struct(at.alias("at"), at_byte.alias("at_byte"), F.when(keep, F.concat(state["found"], F.array(item))).otherwise(state["found"]).alias("found"))

    def outer(state: Column, block: Column) -> Column:
        return F.aggregate(
            F.slice(rows, block * STRETCH + 1, F.lit(STRETCH)), F.struct(state["at"].alias("at"), state["at_byte"].alias("at_byte"), none.alias("found")), inner,
            lambda s: F.struct(s["at"].alias("at"), s["at_byte"].alias("at_byte"), F.concat(state["found"], F.array(s["found"])).alias("found")))

    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / STRETCH).cast("int"))
    return F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.lit(0).alias("at_byte"), many.alias("found")), outer,
        lambda s: F.struct(s["at"].alias("at"), s["at_byte"].alias("at_byte"), F.flatten(s["found"]).alias("found")))


def _spans(rule: Rule, place: int) -> Column:
    """The matches of a rule in ``text`` as (start, place of the kind, kind, end), in code points.

    The gaps between matches come from splitting by the same pattern, so positions are running lengths.
    """
    # Runs of one character class are matched whole, so a lower bound in the pattern drops the short ones early.
    pattern = rule.pattern.removesuffix("+") + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.measured)) if rule.measured else whole
    size = lambda x: F.struct(F.length(x).alias("chars"), F.octet_length(x).alias("bytes"))
    rows = F.arrays_zip(
        F.transform(F.split("text", pattern, -1), size).alias("gap"), F.transform(whole, size).alias("long"), F.transform(measured, lambda x: F.length(x)).alias("kept"))

    def step(state: Column, row: Column) -> tuple[Column, Column, Column, Column]:
        start, start_byte = state["at"] + row["gap"]["chars"], state["at_byte"] + row["gap"]["bytes"]
        end, end_byte = start + F.coalesce(row["long"]["chars"], F.lit(0)), start_byte + F.coalesce(row["long"]["bytes"], F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"),
            start_byte.alias("start_byte"), end_byte.alias("end_byte"))
        return end, end_byte, F.coalesce(row["kept"] >= rule.least, F.lit(False)), span

    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    return F.when(F.rlike("text", F.lit(pattern)), F.get(F.transform(F.array(rows), lambda once: carried(once, step, SPAN)["found"]), F.lit(0))).otherwise(none)


def scan_versions(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings for every path, scanning only what the ledger doesn't have.

    ``paths`` has a row per historical version of a path. Texts are addressed by their SHA-256. ``ledger`` holds
    (blob, kind, version, spans) of earlier runs; pairs of blob and rule version in it are not scanned again. Returns
    (path, blob, spans) for every row of ``paths``, spans sorted by start and place of the kind, and the new ledger.

    A null text is an empty one. Null paths and repeated rows each keep their row; equal texts share one scan. An
    empty table gives no rows. Other columns are not read.
    """
    rows = paths.select(F.col(path).alias(path), known(text).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    # The ledger's rule versions of a blob tell which rules are still to run on it.
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        have = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("have"))
        blobs = blobs.join(have, "blob", "left")
    else:
        blobs = blobs.withColumn("have", F.expr("CAST(NULL AS array<struct<kind:string,version:int>>)"))
    todo = [
        F.when(
            ~F.coalesce(F.array_contains("have", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.lit(False)),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(r, i).alias("spans")))
        for i, r in enumerate(rules)
    ]
    fresh = staged(
        blobs.select("blob", F.array_compact(F.array(*todo)).alias("runs")).filter(F.size("runs") > 0)
        .select("blob", F.explode("runs").alias("run")).select("blob", "run.*"), "secret-ledger")
    full = fresh if ledger is None else ledger.select(fresh.columns).unionByName(fresh)
    live = full.filter(F.size("spans") > 0)
    current = live.filter(F.struct("kind", "version").isin([F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules])) if ledger is not None else live
    found = current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = rows.select(path, "blob").join(found, "blob", "left")
    none = F.expr("CAST(array() AS array<" + SPAN + ">)")
    return joined.select(path, "blob", F.coalesce("spans", none).alias("spans")), full


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = KEY_RULES) -> DataFrame:
    """The table with every span found in ``text`` replaced by ``[kind]``, private keys as a whole.

    All rows and columns stay, whatever their names. Null texts stay null and empty ones empty; overlapping spans are
    replaced by the kinds of those that begin outside of the ones before; equal texts and repeated rows come out alike;
    the work grows with a text's length and its matches; an empty table stays empty. Ids are not read.
    """
    blob, held = unused(docs, "blob"), unused(docs, "held")
    found, _ = scan_versions(docs.select("doc_id", "text"), rules=rules)
    hits = staged(found.filter(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(held)).dropDuplicates([blob]), "secret-hits")
    rows = docs.withColumn(blob, F.unhex(F.sha2(known(), 256))).join(checked(hits, 400), blob, "left")
    # Overlapping spans: the text between is copied from the furthest end reached so far.
    def cut(raw: Column) -> Column:
        def step(state: Column, span: Column) -> tuple[Column, Column, Column, Column]:
            at = state["at_byte"]
            gap = F.substr(raw, at + 1, F.greatest(span["start_byte"] - at, F.lit(0))).cast("string")
            return F.greatest(state["at"], span["end"]), F.greatest(at, span["end_byte"]), span["start_byte"] >= at, F.concat(gap, F.lit("["), span["kind"], F.lit("]"))

        gone = F.transform(F.array(carried(F.col(held), step, "string")), lambda s: F.concat(
            F.array_join(s["found"], ""), F.substr(raw, s["at_byte"] + 1, F.octet_length(raw)).cast("string")))
        return F.get(gone, F.lit(0))

    # As the argument of a function the bytes are made once and not for every span.
    clean = F.get(F.transform(F.array(F.col("text").cast("binary")), cut), F.lit(0))
    text = F.when(F.col(held).isNotNull(), clean).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
