"""Numbers, dates, lists, maps, regions and keys on columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions.text import HAN, _col, han_count, strip, words

# Accepted video suffixes and languages.
VIDEO_SUFFIXES = [".mp4", ".mkv", ".avi", ".mov", ".webm", ".m4v"]
LANGUAGES = ["vi", "en", "id"]
# Words read as true and false.
TRUE_WORDS = ["1", "true", "yes", "on"]
FALSE_WORDS = ["0", "false", "no", "off"]
# A key containing one of these is private.
PRIVATE_MARKS = ["api_key", "token", "password", "secret", "cookie"]


def py_round(x: Column | str, digits: int = 0) -> Column:
    """Half-even rounding of the exact binary value.

    ``bround`` decides ties on the printed decimal, so 26.05 would round down although the
    stored value lies above the tie. The product error tells on which side it lies.
    """
    value = _col(x).cast("double")
    if digits == 0:
        return F.rint(value)
    scale = F.lit(float(10**digits))
    product = value * scale
    big = value * F.lit(134217729.0)
    high = big - (big - value)
    error = (high * scale - product) + (value - high) * scale
    low = F.floor(product).cast("double")
    tie = (product - low) == F.lit(0.5)
    rounded = (
        F.when(tie & (error > 0), low + 1).when(tie & (error < 0), low).otherwise(F.rint(product))
    )
    return rounded / scale


def epoch_ms_to_text(c: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_col(c)), "yyyy-MM-dd HH:mm:ss")


def epoch_day(c: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_col(c)), "yyyy-MM-dd")


# The wait after the first failed attempt, and the longest one.
LEAST_BACKOFF_S, MOST_BACKOFF_S = 3600, 86_400


def backoff_seconds(attempts: Column | str) -> Column:
    """Wait before the next try: one hour doubled per attempt, a day at most."""
    return F.least(F.lit(MOST_BACKOFF_S), F.lit(LEAST_BACKOFF_S) * F.pow(F.lit(2), F.least(_col(attempts), F.lit(10)))).cast("bigint")


def retry_after(c: Column | str) -> Column:
    told = F.regexp_extract(_col(c), r"(?i)retry\s+in\s+([0-9]+(?:\.[0-9]+)?)s", 1).try_cast("double")
    return F.least(F.lit(60.0), F.greatest(F.lit(1.0), F.coalesce(told + 1.0, F.lit(30.0))))


def ass_time(seconds: Column | str) -> Column:
    """``H:MM:SS.cc`` of a number of seconds, fractions of a hundredth dropped."""
    cents = (_col(seconds) * 100).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cents / 360000), F.floor(cents / 6000) % 60, F.floor(cents / 100) % 60, cents % 100,
    )


def ass_time_from_stamp(c: Column | str) -> Column:
    """Subtitle stamp with a dot and, when full length, one digit less."""
    dotted = F.translate(F.trim(_col(c)), ",", ".")
    return F.when(F.length(dotted) > 10, F.left(dotted, F.length(dotted) - 1)).otherwise(dotted)


NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def parse_bool(c: Column | str, default: bool = False) -> Column:
    """Truth of a number (other than zero) or of a word; other words give the default."""
    word = F.lower(strip(_col(c).cast("string")))
    number = F.typeof(_col(c)).isin(NUMBERS) | F.typeof(_col(c)).startswith("decimal")
    return (
        F.when(number & _col(c).isNotNull(), F.coalesce(_col(c).try_cast("double") != 0, F.lit(default)))
        .when(word.isin(TRUE_WORDS), F.lit(True))
        .when(word.isin(FALSE_WORDS), F.lit(False))
        .otherwise(F.lit(default))
    )


def bounded_number(c: Column | str, default: float, low: float, high: float, integer: bool = False) -> Column:
    """Number inside a range, or the reason why not."""
    number = F.coalesce(_col(c).try_cast("double"), F.when(_col(c).isNull(), F.lit(float(default))))
    finite = number.isNotNull() & ~F.isnan(number)
    bad = F.when(~finite, "not_a_number").when(~number.between(low, high), "out_of_range")
    if integer:
        bad = bad.when(number != F.floor(number), "not_integral")
    return F.struct(F.when(bad.isNull(), number).alias("value"), bad.alias("error"))


def valid_region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Ratios of a rectangle inside the frame. Missing x and y are 0, w is 1, h is 0."""
    x, w = F.coalesce(x, F.lit(0.0)), F.coalesce(w, F.lit(1.0))
    y, h = F.coalesce(y, F.lit(0.0)), F.coalesce(h, F.lit(0.0))
    return x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1) & (x + w <= 1.0) & (y + h <= 1.0)


def region_to_pixels(
    x: Column, y: Column, w: Column, h: Column, width: Column, height: Column,
    defaults: tuple[float, float, float, float] = (0.08, 0.86, 0.84, 0.09), even: bool = True,
) -> Column:
    """Pixel rectangle clamped to the frame, at least 4 by 4, on even pixels if asked."""
    dx, dy, dw, dh = (F.lit(d) for d in defaults)

    def px(size: Column, ratio: Column, default: Column) -> Column:
        return (size * F.coalesce(ratio, default)).cast("int")

    left = F.greatest(F.lit(0), F.least(px(width, x, dx), width - 4))
    top = F.greatest(F.lit(0), F.least(px(height, y, dy), height - 4))
    wide = F.greatest(F.lit(4), F.least(px(width, w, dw), width - left))
    tall = F.greatest(F.lit(4), F.least(px(height, h, dh), height - top))
    if even:
        left, top = left - left % 2, top - top % 2
        wide, tall = F.greatest(F.lit(4), wide - wide % 2), F.greatest(F.lit(4), tall - tall % 2)
    return F.struct(left.alias("x"), top.alias("y"), wide.alias("w"), tall.alias("h"))


def font_size(height: Column | str, ratio: float = 0.038, low: int = 20, high: int = 56) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), (_col(height) * F.lit(ratio)).cast("int")))


def side_margins(width: Column, sub_x: Column, sub_w: Column) -> Column:
    least = (width * F.lit(0.04)).cast("int")
    return F.struct(
        F.greatest(least, sub_x).alias("left"), F.greatest(least, width - sub_x - sub_w).alias("right")
    )


def _items(c: Column | str, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), pattern), strip), lambda v: v != "")


def parse_extensions(c: Column | str, allowed: list[str] | None = None) -> Column:
    """Sorted distinct dotted suffixes, or the error that makes the list unusable."""
    allowed = allowed or VIDEO_SUFFIXES
    given = F.transform(
        _items(c, r"[,;\s]+"),
        lambda v: F.when(v.startswith("."), F.lower(v)).otherwise(F.concat(F.lit("."), F.lower(v))),
    )
    known = F.array(*[F.lit(a) for a in sorted(allowed)])
    error = F.when(F.size(F.array_except(given, known)) > 0, "unknown_extension").when(F.size(given) == 0, "empty")
    chosen = F.when(error.isNull(), F.array_sort(F.array_distinct(given)))
    return F.when(_col(c).isNull(), F.struct(known.alias("value"), F.lit(None).cast("string").alias("error"))).otherwise(
        F.struct(chosen.alias("value"), error.alias("error"))
    )


def parse_languages(c: Column | str, allowed: list[str] | None = None) -> Column:
    """Known languages of a JSON list in given order, each once."""
    listed = F.from_json(_col(c), "array<string>")
    known = F.array(*[F.lit(a) for a in (allowed or LANGUAGES)])
    kept = F.filter(listed, lambda v: F.array_contains(known, v))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def parse_ids(c: Column | str) -> Column:
    """Distinct integers of a separated list; anything else is skipped."""
    numbers = F.transform(_items(c, r"[,\s;]+"), lambda v: v.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda v: v.isNotNull())))


def parse_keys(c: Column | str, limit: int = 16) -> Column:
    return F.slice(F.array_distinct(_items(c, ",")), 1, limit)


def is_public_key(key: Column) -> Column:
    hidden = key.startswith("_")
    for mark in PRIVATE_MARKS:
        hidden = hidden | F.lower(key).contains(mark)
    return ~hidden


def public_view(c: Column | str) -> Column:
    """Map without private keys."""
    return F.map_filter(_col(c), lambda k, _v: is_public_key(k))


def public_view_nested(c: Column | str) -> Column:
    """Map of maps without private keys on either level."""
    return F.transform_values(public_view(c), lambda _k, v: F.map_filter(v, lambda k, _x: is_public_key(k)))


def _private(name: str) -> bool:
    return name.startswith("_") or any(mark in name.lower() for mark in PRIVATE_MARKS)


def public_value(c: Column, kind: T.DataType) -> Column:
    """A value of any type without private keys: of maps, fields of structs, and those inside arrays, at every depth.

    The expression follows the type, so that Spark reads no field that is dropped. NULL stays NULL.
    """
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: public_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(c, lambda k, _v: is_public_key(k)) if isinstance(kind.keyType, T.StringType) else c
        return F.transform_values(kept, lambda _k, v: public_value(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if not _private(f.name)]
        return F.when(c.isNotNull(), F.struct(*[public_value(c[f.name], f.dataType).alias(f.name) for f in fields])) if fields else F.lit(None)
    return c


def public_rows(df: DataFrame) -> DataFrame:
    """A table without private columns and without private keys inside the others."""
    return df.select(*[public_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if not _private(f.name)])


def identity_key(*parts: Column | str, length: int = 24) -> Column:
    """Content key: the first hex digits of the SHA-256 of a JSON list."""
    listed = F.to_json(F.array(*[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]))
    return F.substring(F.sha2(listed, 256), 1, length)


def package_key(batch: Column, item: Column, source_hash: Column, video_hash: Column) -> Column:
    # Fixed format: prefix, then 24 hex digits of the hash of the joined parts.
    joined = F.concat_ws("|", batch, item, source_hash, video_hash)
    return F.concat(F.lit("dysrt_"), F.substring(F.sha2(joined, 256), 1, 24))


def _compositions() -> str:
    """Letters with marks and what they compose to, as ``letter marks`` pairs, by the rule of the Unicode tables."""
    pairs = {}
    for code in range(0x00C0, 0x3100):
        whole = chr(code)
        apart = unicodedata.normalize("NFD", whole)
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == whole:
            pairs[apart] = whole
            # The first marks may be composed already.
            pairs[unicodedata.normalize("NFC", apart[:-1]) + apart[-1]] = whole
    return "\u0001".join(f"{apart}\u0002{whole}" for apart, whole in pairs.items())


def composed(c: Column | str) -> Column:
    """Text whose letters and marks are composed (NFC) where one letter exists for them."""
    table = F.str_to_map(F.lit(_compositions()), F.lit("\u0001"), F.lit("\u0002"))
    clusters = F.regexp_extract_all(_col(c), F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    return F.when(_col(c).rlike(r"\p{M}"), F.array_join(
        F.transform(clusters, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")).otherwise(_col(c))


def _span(han: Column, chars: Column, size: Column) -> Column:
    """Width of a run of characters: a size per Han character, .58 of it per other one."""
    return (han * size).cast("double") + (chars - han).cast("double") * (size.cast("double") * F.lit(0.58))


def _pieces(words_: Column, room: Column, size: Column) -> Column:
    """What lines are made of: words, and pieces of words that are wider than a line.

    ``opens`` tells that a piece begins a line whatever the room is: a paragraph's first word and pieces of wide words.
    """

    def cut(word: Column) -> Column:
        def add(acc: Column, char: Column) -> Column:
            han = char.rlike(HAN).cast("int")
            full = (acc["chars"] > 0) & (_span(acc["han"] + han, acc["chars"] + 1, size) > room)
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["text"]))).otherwise(acc["done"]).alias("done"),
                F.when(full, char).otherwise(F.concat(acc["text"], char)).alias("text"),
                F.when(full, han).otherwise(acc["han"] + han).alias("han"),
                F.when(full, 1).otherwise(acc["chars"] + 1).alias("chars"),
            )

        begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("han"), F.lit(0).alias("chars"))
        parts = F.aggregate(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), begin, add, lambda acc: F.concat(acc["done"], F.array(acc["text"])))
        return F.transform(parts, lambda p: F.struct(p.alias("text"), han_count(p).alias("han"), F.char_length(p).alias("chars"), F.lit(True).alias("opens")))

    return F.flatten(F.transform(words_, lambda w: F.when(_span(w["han"], w["chars"], size) <= room, F.array(w)).otherwise(cut(w["text"]))))


def _lines(pieces: Column, room: Column, size: Column) -> Column:
    """Pieces joined to lines no wider than ``room``: texts of lines and the widest of them."""

    def add(acc: Column, p: Column) -> Column:
        han, chars = acc["han"] + p["han"], acc["chars"] + 1 + p["chars"]
        opens = p["opens"] | (acc["chars"] == 0) | (_span(han, chars, size) > room)
        return F.struct(
            F.when(opens & (acc["chars"] > 0), F.concat(acc["done"], F.array(acc["text"]))).otherwise(acc["done"]).alias("done"),
            F.when(opens, p["text"]).otherwise(F.concat(acc["text"], F.lit(" "), p["text"])).alias("text"),
            F.when(opens, p["han"]).otherwise(han).alias("han"), F.when(opens, p["chars"]).otherwise(chars).alias("chars"),
            F.greatest(acc["widest"], F.when(opens, _span(p["han"], p["chars"], size)).otherwise(_span(han, chars, size))).alias("widest"),
        )

    begin = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("han"), F.lit(0).alias("chars"), F.lit(0.0).alias("widest"))
    return F.aggregate(pieces, begin, add, lambda acc: F.struct(F.concat(acc["done"], F.array(acc["text"])).alias("lines"), acc["widest"].alias("widest")))


def fit_layout(text: Column | str, width: Column, height: Column, largest: Column, smallest: Column) -> Column:
    """Lines and font size of a subtitle in its region, by an estimate of widths.

    The largest size at which at most four lines fit; if none fits, the smallest one with ``overflow``. Nothing of the
    text is dropped; words wider than a line are cut. Widths are summed per word once, sizes are tried downward.
    """
    clean = composed(strip(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\r"), F.lit(""))))
    paragraphs = F.split(clean, "[\n\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.transform(words(p), lambda w, i: F.struct(
        w.alias("text"), han_count(w).alias("han"), F.char_length(w).alias("chars"), (i == 0).alias("opens")))))
    room, tall = F.greatest(F.lit(12), width - 12), F.greatest(F.lit(8), height - 8)
    floor = F.least(largest, F.greatest(F.lit(12), smallest))

    def tried(parts: Column, size: Column) -> Column:
        stack = lambda lines: F.size(lines["lines"]) * size * F.lit(1.15)
        fits = lambda lines: (F.size(lines["lines"]) <= 4) & (stack(lines) <= tall) & (lines["widest"] <= room)
        made = F.transform(F.array(_lines(_pieces(parts, room, size), room, size)), lambda lines: F.when(fits(lines) | (size == floor), F.struct(
            lines["lines"].alias("lines"), size.cast("int").alias("font_size"), lines["widest"].alias("width"), stack(lines).cast("double").alias("height"), (~fits(lines)).alias("overflow"))))
        return F.get(made, F.lit(0))

    none = F.lit(None).cast("struct<lines:array<string>,font_size:int,width:double,height:double,overflow:boolean>")
    # As the argument of a function the words are split once and not for every size.
    total = lambda once, name: F.aggregate(once, F.lit(0), lambda n, p: n + p[name])
    told = F.transform(F.array(parts), lambda once: F.struct(once.alias("parts"), total(once, "han").alias("han"), total(once, "chars").alias("chars")))
    # More than four lines' worth of text needs no trial.
    many = lambda once, size: (_span(once["han"], once["chars"], size) > 4 * room) & (size > floor)
    return F.get(F.transform(told, lambda once: F.aggregate(F.sequence(largest, floor, F.lit(-1)), none, lambda best, size: F.when(
        best.isNotNull() | many(once, size), best).otherwise(tried(once["parts"], size)))), F.lit(0))
