"""Spans of regular expressions as built-in Spark expressions; positions are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters before and behind a match that context labelers see.
CONTEXT = 40
FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Positions are summed in chunks, and chunks' totals after that: appending to one array for a whole text would be quadratic.
CHUNK = 256
#: Stands for what masked() hides; no pattern here matches it.
HIDDEN = "\ue000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _indices(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)


def _before_each(values: Column, kind: str, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of some values, all before it merged with 0."""
    zero = F.struct(F.lit(0).cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct(merge(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")), lambda acc: acc["out"])


def found(text: Column, pattern: str) -> Column:
    """FOUND: all leftmost non-overlapping matches, none of which is empty.

    What lies between the matches (split) and the matches themselves give the positions. Texts without a match cost one
    search. Patterns must be free of nested greedy groups and start only where a run starts, so that a very long
    run is passed once.
    """

    def chunk(b: Column, low: Column) -> Column:
        """Length of a chunk of matches with their gaps, and the matches, placed from the chunk's begin."""

        def step(acc: Column, i: Column) -> Column:
            value, gap = F.get(b["v"], i), F.get(b["g"], i)
            start = acc["at"] + F.length(gap)
            end = start + F.length(value)
            one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.get(b["g"], i + 1), F.lit(CONTEXT)).alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))
        return F.aggregate(F.sequence(low, F.least(low + CHUNK, F.size(b["v"])) - 1), zero, step)

    def placed(b: Column) -> Column:
        chunks = F.transform(_indices(F.ceil(F.size(b["v"]) / CHUNK).cast("int")), lambda c: chunk(b, c * CHUNK))
        return let(chunks, lambda cs: F.flatten(F.zip_with(cs, _before_each(F.transform(cs, lambda c: c["at"]), "int", lambda x, y: x + y), moved)))

    def moved(c: Column, by: Column) -> Column:
        return F.transform(c["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("g"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(FOUND))


def masked(text: Column, pattern: str, hides: Callable[[Column], Column]) -> Column:
    """text with the matches that `hides` takes replaced by as many HIDDEN characters, so positions stay."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("g"))

    def joined(b: Column) -> Column:
        shown = F.transform(b["v"], lambda v: F.when(hides(v), F.repeat(F.lit(HIDDEN), F.length(v))).otherwise(v))
        return F.array_join(F.flatten(F.zip_with(b["g"], shown, lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")

    return F.when(text.rlike(pattern), let(both, joined)).otherwise(text)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    """Luhn's checksum over the digits of a value."""
    number = F.split(F.reverse(digits(value)), "(?<=.)(?=.)")
    doubled = F.transform(number, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """ISO 7064's checksum of an IBAN: letters count from 10 on, the first four characters come last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "(?<=.)(?=.)")
    each = F.transform(signs, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(each, F.lit(0), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97) == 1


def as_spans(matches: Column, kind: int) -> Column:
    """array<struct<start, kind, end>>, which sorts by start, then kind."""
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, kinds: list[str]) -> Column:
    """text with every span replaced by [KIND]; of overlapping spans the first counts, the others are covered with it.

    Cut chunk by chunk: a chunk of spans only reads its own stretch of the text.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in kinds])

    def stretch(t: Column, s: Column, i: Column, reach: Column) -> Column:
        low = F.when(i == 0, 0).otherwise(F.get(s, i * CHUNK)["start"])
        high = F.coalesce(F.get(s, (i + 1) * CHUNK)["start"], F.length(t))
        return let(F.struct(F.substring(t, low + 1, high - low).alias("t"), low.alias("low"), high.alias("high")), lambda x: cut(x, F.slice(s, i * CHUNK + 1, F.lit(CHUNK)), reach))

    def cut(x: Column, s: Column, reach: Column) -> Column:
        def step(acc: Column, one: Column) -> Column:
            piece = F.concat(F.substring(x["t"], acc["at"] - x["low"] + 1, one["start"] - acc["at"]), F.get(names, one["kind"]))
            fresh = one["start"] >= acc["at"]
            return F.struct(F.greatest(acc["at"], one["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.greatest(x["low"], reach).alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda acc: F.when(acc["at"] < x["high"], F.substring(x["t"], acc["at"] - x["low"] + 1, x["high"] - acc["at"])).otherwise("")
        return F.aggregate(s, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), rest(acc)))

    def whole(x: Column) -> Column:
        parts = _indices(F.ceil(F.size(x["s"]) / CHUNK).cast("int"))
        reaches = _before_each(F.transform(parts, lambda i: F.array_max(F.transform(F.slice(x["s"], i * CHUNK + 1, F.lit(CHUNK)), lambda one: one["end"]))), "int", F.greatest)
        return F.array_join(F.zip_with(parts, reaches, lambda i, reach: stretch(x["t"], x["s"], i, reach)), "")

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("t"), F.array_sort(spans).alias("s")), whole)).otherwise(text)
