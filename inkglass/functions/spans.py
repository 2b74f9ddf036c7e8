"""Spans of regular-expression matches, and splicing of texts by spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = "array<struct<start:int,end:int,text:string>>"
#: Items that one inner fold of :func:`scan` gathers.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(name: str) -> Column:
    """A column for a UDF's argument, named twice, so that it is computed before the UDF.

    Spark would write its expression into the UDF's arguments if it occurred once, where
    it cannot evaluate lambdas.
    """
    return F.when(F.col(name).isNotNull(), F.col(name))


def by_row(function: Callable, kind: str | T.DataType) -> Callable[..., Column]:
    """A Python function of whole texts as a column function.

    Rows go to Python by the hundred: a worker holds few texts and results at a time, however
    many rows its task has. Arrow's batches take ten thousand.
    """
    return F.udf(function, kind, useArrow=False)


def scan(items: Column, first: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """``array<kind>`` of what ``step(state, item)``, which gives the next state and an array, gives for all items.

    An array that grows item by item is copied each time, so items are gathered in blocks,
    and these in one array in the end.
    """
    none, nested = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["at"], item)
        return F.struct(state.alias("at"), F.concat(acc["out"], out).alias("out"))

    def blocks_of(all_items: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), none.alias("out"))
            whole = lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))
            return F.aggregate(F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK)), start, one, whole)

        blocks = F.sequence(F.lit(0), F.floor(F.size(all_items) / BLOCK).cast("int"))
        return F.flatten(F.aggregate(blocks, F.struct(first.alias("at"), nested.alias("out")), block, lambda a: a["out"]))

    return let(items, blocks_of)


def match_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, text>>`` of all matches, in code points, end exclusive.

    The gaps that ``split`` leaves are as long as the way from one match to the next.
    Patterns must not match the empty string. Null texts and texts without a match have none.
    """

    # there is one gap more than matches, so the last pair has no match
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("text"))
        return end, F.when(p["hit"].isNotNull(), F.array(span)).otherwise(F.array().cast(SPANS))

    found = scan(pairs, F.lit(0), "struct<start:int,end:int,text:string>", step)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the given spans; overlapping ones are cut once."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        kept = F.when(s["start"] > at, F.array(F.substring(text, at + 1, s["start"] - at))).otherwise(F.array().cast("array<string>"))
        return F.greatest(at, s["end"]), kept

    def cut(sorted_spans: Column) -> Column:
        last = F.substring(text, F.array_max(F.transform(sorted_spans, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(F.array_join(scan(sorted_spans, F.lit(0), "string", step), ""), last)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.array_sort(spans), cut))


PLACED = "array<struct<line:int,column:int,offset:int>>"


def places_of(text: Column, offsets: Column) -> Column:
    """``array<struct<line, column, offset>>``: where each of an array of offsets lies, in its order.

    Lines end at LF only; lines and columns count from 1, offsets from 0, in code points. The
    lines' starts and the offsets are sorted together and gone through once, so many offsets
    of a long text cost little more than a few.
    """
    lines = F.split(text, "\n", -1)
    kind = "struct<at:int,turn:int>"

    def start(at: Column, line: Column) -> tuple[Column, Column]:
        return at + F.length(line) + 1, F.array(F.struct(at.alias("at"), F.lit(-1).alias("turn")))

    asked = F.transform(offsets, lambda o, i: F.struct(o.cast("int").alias("at"), i.alias("turn")))
    none = F.expr("cast(array() as array<struct<turn:int,line:int,column:int,offset:int>>)")

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        # a line's start comes before what is asked at the same offset
        place = F.struct(x["turn"].alias("turn"), state["line"].alias("line"), (x["at"] - state["at"] + 1).alias("column"), x["at"].alias("offset"))
        after = F.struct((state["line"] + 1).alias("line"), x["at"].alias("at"))
        return F.when(x["turn"] < 0, after).otherwise(state), F.when(x["turn"] < 0, none).otherwise(F.array(place))

    events = F.array_sort(F.concat(scan(lines, F.lit(0), kind, start), asked))
    found = scan(events, F.struct(F.lit(0).alias("line"), F.lit(0).alias("at")), "struct<turn:int,line:int,column:int,offset:int>", step)
    in_order = F.transform(F.array_sort(found), lambda p: F.struct(p["line"].alias("line"), p["column"].alias("column"), p["offset"].alias("offset")))
    return F.when(F.size(offsets) > 0, in_order).otherwise(F.expr(f"cast(array() as {PLACED})"))


def span_places(text: Column, spans: Column) -> Column:
    """:func:`places_of` the starts and ends of spans, in turn: start, end, start, end ..."""
    return places_of(text, F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))))
