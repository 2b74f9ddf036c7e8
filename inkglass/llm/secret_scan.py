"""Secret scan: patterns of known credentials, and sliding-window entropy for the rest.

Built-in expressions only, one narrow projection over whole texts. All positions are code
points, start inclusive and end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let, match_spans, scan

# The patterns of the base rules, with the length that a match must reach.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_LENGTH = 6
# Runs are maximal, so a length asked for inside the pattern finds what a length asked for
# afterwards would leave, and no run is tried but from its start.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"

KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, tried in this order: name, what the whole candidate must match, what
#: it must contain, and the bits per character that a window must reach.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", r"[0-9].*[a-fA-F]|[a-fA-F].*[0-9]", 2.95),
    ("alnum", r"^[A-Za-z0-9]+$", r"(?=.*[0-9])(?=.*[A-Za-z])", 3.65),
    # letters of one case, with a part between marks that mixes them with digits: words and numbers alone do not
    ("one_case", r"^(?:[a-z0-9+/_=-]+|[A-Z0-9+/_=-]+)$", r"[0-9][A-Za-z]+[0-9]|[A-Za-z][0-9]+[A-Za-z]", 3.85),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 3.85),
)
#: Candidates that are no secrets: UUIDs, words joined by marks, numbers and dates, example keys.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z][A-Za-z+/_=-]*$",
    r"^[0-9+/_=-]+$",
    r"(?i)example|placeholder|changeme|xxxx",
)


def _match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<start, end, text>>`` of the leftmost non-overlapping matches that ``keep`` wants."""
    return F.filter(match_spans(text, pattern), keep) if keep else match_spans(text, pattern)


#: c log2 c is counted in units of 2**-32, so that sums are exact however long a candidate is.
UNIT = 2.0**32


def _weights(window: int) -> list[int]:
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))]


def _hot_range(s: Column, window: int, bits: Column) -> Column:
    """First start and last end of windows whose entropy reaches ``bits``, both null if there is none.

    With S = sum of c log2 c over the window's characters, its entropy is log2(w) - S/w. The
    fold enters the first w characters and from then on takes one out and one in. Its state
    holds every ASCII character's count, as a string of 128 characters, and S, of which a
    change of one count moves one term.
    """
    w, zero_count = window, ord("@")
    weights = F.array(*map(F.lit, _weights(w)))

    def fold(chars: Column) -> Column:
        n = F.size(chars)
        none = F.lit(None).cast("int")
        zero = F.struct(
            F.repeat(F.lit(chr(zero_count)), 128).alias("counts"), F.lit(0).cast("long").alias("sum"), none.alias("lo"), none.alias("hi")
        )

        def step(state: Column, e: Column) -> Column:
            pair = F.shiftright(e - w, 1)
            enters = (e < w) | ((e - w) % 2 == 1)
            at = F.when(e < w, e).when(enters, pair + w).otherwise(pair)
            place = F.ascii(F.element_at(chars, at + 1)) + 1

            def change(p: Column) -> Column:
                def apply(c: Column) -> Column:
                    now = F.when(enters, c + 1).otherwise(c - 1)
                    total = state["sum"] - F.element_at(weights, c + 1) + F.element_at(weights, now + 1)
                    full = (e >= w - 1) & ((e - w) % 2 != 0)
                    start = F.shiftright(e - w + 1, 1)

                    def moved(sum_: Column) -> Column:
                        hot = full & (F.lit(math.log2(w)) - sum_ / F.lit(UNIT * w) >= bits)
                        return F.struct(
                            F.overlay(state["counts"], F.char(now + zero_count), p, F.lit(1)).alias("counts"),
                            sum_.alias("sum"),
                            F.when(hot & state["lo"].isNull(), start).otherwise(state["lo"]).alias("lo"),
                            F.when(hot, start + w).otherwise(state["hi"]).alias("hi"),
                        )

                    return let(total, moved)

                return let(F.ascii(F.substring(state["counts"], p, F.lit(1))) - zero_count, apply)

            return let(place, change)

        return F.aggregate(F.sequence(F.lit(0), n * 2 - w - 1), zero, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))

    return F.when(F.length(s) >= w, let(F.split(s, ""), fold))


def _class_bits(s: Column) -> Column:
    """The threshold of the candidate's character class; null where it is no candidate of any."""
    out = F.lit(None).cast("double")
    for _, whole, has, bits in reversed(CLASSES):
        out = F.when(s.rlike(whole), F.when(s.rlike(has), bits)).otherwise(out)
    for allowed in ALLOWED:
        out = F.when(~s.rlike(allowed), out)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``id_col, text, spans``.

    ``spans`` is ``array<struct<kind, start, end>>`` by start, then kind in the order of
    :data:`KINDS`. Base kinds (assign, access, hex) list every match of their pattern.
    ``entropy`` adds the part of a candidate string from its first to its last window whose
    Shannon entropy reaches its class's threshold, unless the allow-list names it or a base
    span covers it. Null and empty texts have no spans. Other columns are ignored, repeated
    rows are scanned alike, an empty table gives no rows. Long texts and long candidates cost
    in proportion to their length; a text with k matches of a kind holds k spans.
    """
    text = F.col("text")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = base.select(
        "id",
        "text",
        _match_spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= ASSIGN_VALUE_LENGTH).alias("assign"),
        _match_spans(text, ACCESS).alias("access"),
        _match_spans(text, HEX).alias("hex"),
        _match_spans(text, CANDIDATE).alias("candidates"),
    )
    def kind(name: str, start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(name)).alias("rank"), end.cast("int").alias("end"), F.lit(name).alias("kind"))

    def of_kind(name: str) -> Column:
        return F.transform(F.col(name), lambda m: kind(name, m["start"], m["end"]))

    known = F.concat(*map(of_kind, KINDS[:3]))
    scored = F.transform(
        "candidates",
        lambda m: F.struct(m["start"].alias("at"), m["text"].alias("text"), _class_bits(m["text"]).alias("bits")),
    )
    hot = F.transform(
        F.filter("scored", lambda m: m["bits"].isNotNull()),
        lambda m: F.struct(m["at"].alias("at"), _hot_range(m["text"], window, m["bits"]).alias("range")),
    )
    added = F.transform(
        F.filter("hot", lambda m: m["range"]["lo"].isNotNull()),
        lambda m: kind("entropy", m["at"] + m["range"]["lo"], m["at"] + m["range"]["hi"]),
    )
    shape = "struct<start:int,rank:int,end:int,kind:string>"

    def uncovered(reach: Column, m: Column) -> tuple[Column, Column]:
        # by start, base kinds first: what base spans reach so far
        is_base = m["kind"] != "entropy"
        stays = is_base | (m["end"] > reach)
        return F.when(is_base, F.greatest(reach, m["end"])).otherwise(reach), F.when(stays, F.array(m)).otherwise(F.array().cast(f"array<{shape}>"))

    return (
        spans.select("id", "text", known.alias("known"), scored.alias("scored"))
        .select("id", "text", "known", hot.alias("hot"))
        .select("id", "text", F.when((F.size("known") > 0) | (F.size(added) > 0), scan(F.array_sort(F.concat("known", added)), F.lit(-1), shape, uncovered)).alias("_spans"))
        .withColumn("_spans", F.coalesce("_spans", F.array().cast(f"array<{shape}>")))
        .select(
            F.col("id").alias(id_col),
            F.col("text"),
            F.transform("_spans", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))).alias("spans"),
        )
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of :func:`find_secrets`'s rows."""
    count = lambda name: F.size(F.filter("spans", lambda m: m["kind"] == name)).cast("long")
    base = F.filter("spans", lambda m: m["kind"] != "entropy")
    return found.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
