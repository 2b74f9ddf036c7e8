"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Links are always verified on the full sets, hashed again from the whole texts.

1.  Each document's shingle set gives a signature of bands * rows coordinates, all from two
    permutations (:func:`.shingles.circulant_minhash`). Equal sets become one node, so
    copies cost nothing from here on.
2.  Nodes that share a band's key meet in a bucket. First every node of a bucket is compared
    with the bucket's least node only, and components are formed from the links found.
3.  What these leave open are pairs of a bucket from different components. They are compared
    in blocks of bounded size, first by their signatures and, where these allow a link, by
    their full sets; only links leave a block. No other pair can join two components.

A pair of similarity s shares a bucket with probability 1 - (1 - s^rows)^bands, which is
over 0.99999 at 0.8 with 6 rows and 40 bands. A comparison of signatures passes over a pair
of similarity 0.8 or more with a probability under one in a million (``SLACK`` standard
deviations); it only spares work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import connected_components
from .shingles import band_keys, circulant_minhash, jaccard_parts, shingle_sets

SLACK = 5.0
#: Texts that are shingled together, at most, in characters (a longer one goes alone).
CHUNK_CHARS = 2_000_000
#: Members of a bucket that one block holds.
BLOCK = 1024
#: Members that are verified against one copy of a bucket's least node.
FAN = 256


def _chunks(texts: pd.Series) -> Iterator[tuple[int, list[str | None]]]:
    start, chars, values = 0, 0, texts.tolist()
    for i, t in enumerate(values):
        n = len(t) if t else 0
        if i > start and chars + n > CHUNK_CHARS:
            yield start, values[start:i]
            start, chars = i, 0
        chars += n
    if start < len(values):
        yield start, values[start:]


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signatures(docs: DataFrame, k: int, rows_a_band: int, bands: int) -> DataFrame:
    """``id, text_key, n_shingles, sid, bands, sketch``; a document without words has no more than its keys and 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, texts in _chunks(batch["text"]):
                sets = shingle_sets(texts, k)
                rows = slice(start, start + len(texts))
                out = pd.DataFrame({"id": batch["id"].iloc[rows].to_numpy(), "text_key": batch["text_key"].iloc[rows].to_numpy(), "n_shingles": [len(s) for s in sets]})
                full = [i for i, s in enumerate(sets) if len(s)]
                columns: dict[str, list] = {c: [None] * len(sets) for c in ("sid", "bands", "sketch")}
                if full:
                    signature = circulant_minhash([sets[i] for i in full], rows_a_band * bands)
                    keys, sketch = band_keys(signature, rows_a_band), signature.astype(np.uint8)
                    for j, i in enumerate(full):
                        columns["sid"][i], columns["bands"][i], columns["sketch"][i] = _set_key(sets[i]), keys[j], sketch[j].tobytes()
                yield out.assign(**columns)

    kind = dict(docs.dtypes)["id"]
    return docs.mapInPandas(run, f"id {kind}, text_key binary, n_shingles long, sid binary, bands array<long>, sketch binary")


def _least_matches(width: int, share: float) -> int:
    """Equal sketch bytes that a pair of similarity ``share`` has at least, but for odd luck.

    Unequal coordinates agree in one byte of 256.
    """
    p = share + (1 - share) / 256
    return math.floor(width * p - SLACK * math.sqrt(width * p * (1 - p)))


def _may_link(pairs: DataFrame, share: float, width: int) -> DataFrame:
    """Pairs whose sizes and sketches allow a link, from ``a, b, members, na, nb, sa, sb``."""
    least = _least_matches(width, share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                sa, sb = (np.frombuffer(b"".join(p[c]), np.uint8).reshape(len(p), width) for c in ("sa", "sb"))
                p = p[(sa == sb).sum(1) >= least]
            yield p[["a", "b", "members"]]

    sizes = F.least("na", "nb") >= F.lit(share) * F.greatest("na", "nb")
    return pairs.filter(sizes).select("a", "b", "members", "sa", "sb").mapInPandas(run, "a binary, b binary, members long")


def _across(members: DataFrame, share: float, width: int, k: int, percent: int) -> DataFrame:
    """Links of a block's nodes that are from different components.

    ``members``: ``bucket, part, side, sid, n, label, sketch, text``, with the rows of a
    block together. A block of one part compares its members with each other, a block of two
    parts those of one with those of the other. Pairs whose sketches allow a link are
    verified on their full sets here, so only links leave the block.
    """
    least = _least_matches(width, share)

    def block(p: pd.DataFrame) -> pd.DataFrame | None:
        if not len(p):
            return None
        n, labels, sides = p["n"].to_numpy(), pd.factorize(p["label"])[0], p["side"].to_numpy()
        order = np.argsort(n, kind="stable")
        n, labels, sides = n[order], labels[order], sides[order]
        sketch = np.frombuffer(b"".join(p["sketch"]), np.uint8).reshape(len(p), width)[order]
        two = sides.min() != sides.max()
        pairs = []
        # the larger of two sets is at most 1 / share times the smaller
        ends = np.searchsorted(n, n / share * (1 + 1e-9), "right")
        for i in range(len(n) - 1):
            j = np.arange(i + 1, ends[i])
            j = j[(labels[j] != labels[i]) & ((sides[j] != sides[i]) | (not two))]
            if len(j):
                pairs += [(i, x) for x in j[(sketch[j] == sketch[i]).sum(1) >= least].tolist()]
        if not pairs:
            return None
        sid, texts, sets = p["sid"].to_numpy()[order], p["text"].to_numpy()[order], {}
        wanted = pd.Series(texts[sorted({x for pair in pairs for x in pair})], index=sorted({x for pair in pairs for x in pair}))
        for start, chunk in _chunks(wanted):
            sets |= zip(wanted.index[start : start + len(chunk)], shingle_sets(chunk, k))
        links = []
        for i, j in pairs:
            both, either = jaccard_parts(sets[i], sets[j])
            if 100 * both >= percent * either:
                links.append((min(sid[i], sid[j]), max(sid[i], sid[j])))
        return pd.DataFrame(links, columns=["a", "b"]) if links else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            key = batch[["bucket", "part"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(batch)]):
                now = tuple(key[start]) if len(key) else last
                if held and now != last:
                    if (out := block(pd.concat(held, ignore_index=True))) is not None:
                        yield out
                    held = []
                held.append(batch.iloc[start:end])
                last = now
        if held and (out := block(pd.concat(held, ignore_index=True))) is not None:
            yield out

    sorted_members = members.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return sorted_members.mapInPandas(run, "a binary, b binary").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b`` of the pairs that are links on their full sets.

    ``texts``: ``sid, text``; ``pairs``: ``a, b, members``, of which ``members`` bounds the
    partners of ``a``. Its text goes once to about every ``FAN`` of them, so that a node
    with very many is spread out; partners stream past it one by one.
    """
    placed = pairs.withColumn("fan", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / FAN)).cast("int"))
    members = placed.select("a", "fan", F.lit(1).alias("role"), F.col("b").alias("_sid"))
    heads = placed.select("a", "fan").distinct().select("a", "fan", F.lit(0).alias("role"), F.col("a").alias("_sid"))
    wanted = stash(heads.union(members), "near-wanted")
    rows = wanted.join(texts, F.col("_sid") == F.col("sid")).select("a", "fan", "role", "sid", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, head = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for start, chunk in _chunks(batch["text"]):
                part = batch.iloc[start : start + len(chunk)]
                for a, fan, role, sid, s in zip(part["a"], part["fan"], part["role"], part["sid"], shingle_sets(chunk, k)):
                    if role == 0:
                        at, head = (a, fan), s
                    elif at == (a, fan):
                        both, either = jaccard_parts(head, s)
                        if 100 * both >= percent * either:
                            found.append((a, sid))
            yield pd.DataFrame(found, columns=["a", "b"])

    return rows.repartition("a", "fan").sortWithinPartitions("a", "fan", "role").mapInPandas(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    rows: int = 6,
    bands: int = 40,
) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept, set_key, text_key``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their shingle
    sets. ``component_id`` is the smallest id reachable through links, and ``kept`` marks
    the row that bears it. Words are cut at ASCII white space and lower-cased in A-Z; a text
    of fewer words than a shingle is one shingle. Null and empty texts and texts of white
    space have no shingles, are linked with nothing and are kept. A row with a null id is
    kept; it can be linked only with texts of the same set, and has a null component where
    no row of its component has an id. Rows that repeat an id are documents of their own
    that share its fate. Other columns are ignored; an empty table gives no rows. Texts of any
    length are read whole, in segments; the longest word is held at once.

    Sets are sets of 64-bit hashes that mix every bit of every word: two texts of n and m
    shingles, compared once, are misjudged with a probability of about n * m / 2**64.
    """
    share, width = percent / 100, rows * bands
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stash(_signatures(plain.withColumn("text_key", _text_key("text")), shingle_words, rows, bands), "near-signatures")
    full = signed.filter("sid is not null")
    nodes = stash(
        full.groupBy("sid").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        ),
        "near-nodes",
    )

    # buckets of two nodes and more
    slots = nodes.select(F.explode("bands").alias("bucket"), "sid")
    heads = stash(slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("sid").alias("head")).filter("members > 1"), "near-buckets")
    buckets = stash(slots.join(heads, "bucket"), "near-members")

    # texts of the nodes that share a bucket at all; the set of a text is checked again below
    shared = buckets.select("sid").distinct()
    known = stash(nodes.join(shared, "sid", "left_semi").select("sid", "id", "n", "sketch"), "near-known")
    fetched = plain.join(known.select("id", "sid").filter("id is not null"), "id").select("sid", "text")
    texts = stash(_with_set(fetched, shingle_words), "near-texts")

    def sketched(pairs: DataFrame) -> DataFrame:
        side = lambda x: known.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        return stash(pairs.join(side("a"), "a"), "near-sketched").join(side("b"), "b")

    stars = buckets.filter("sid != head").groupBy(F.col("head").alias("a"), F.col("sid").alias("b")).agg(F.max("members").alias("members"))
    stars = stash(stars, "near-stars")
    first = stash(_verify(stash(_may_link(sketched(stars), share, width), "near-pairs"), texts, shingle_words, percent), "near-links")
    labels = connected_components(first)

    # what is left: buckets with members of different components
    labelled = stash(
        buckets.join(labels, F.col("sid") == F.col("id"), "left").select("bucket", "members", "sid", F.coalesce("label", "sid").alias("label")), "near-labelled"
    )
    mixed = stash(labelled.groupBy("bucket").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).filter("_l != _h").select("bucket"), "near-mixed")
    open_ = stash(labelled.join(mixed, "bucket"), "near-open").join(known.select("sid", "n", "sketch"), "sid").join(texts, "sid")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    members = (
        open_.withColumn("own", own)
        .withColumn("other", other)
        .select(
            "bucket",
            (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("part"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
            "sid",
            "n",
            "label",
            "sketch",
            "text",
        )
    )
    second = _across(members, share, width, shingle_words, percent)
    components = connected_components(first.union(second))

    least = full.join(components.withColumnRenamed("id", "_c"), F.col("sid") == F.col("_c"), "left").select("sid", "id", F.coalesce("label", "sid").alias("label"))
    smallest = stash(least.groupBy("label").agg(F.min("id").alias("component_id")), "near-smallest")
    mapped = stash(
        nodes.select("sid")
        .join(components.withColumnRenamed("id", "_c"), F.col("sid") == F.col("_c"), "left")
        .select("sid", F.coalesce("label", "sid").alias("label"))
        .join(smallest, "label")
        .select(F.col("sid").alias("_sid"), "component_id"),
        "near-map",
    )
    component = F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return signed.join(mapped, F.col("sid") == F.col("_sid"), "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        (F.col("id").isNull() | F.col("id").eqNullSafe(component)).alias("kept"),
        F.hex("sid").alias("set_key"),
        "text_key",
    )


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, told by id and text."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    dropped = found.filter("not kept").select(F.col(id_col).alias("id"), "text_key").distinct().alias("dropped")
    rows = docs.alias("docs")
    met = (F.col(f"docs.`{id_col}`") == F.col("dropped.id")) & (_text_key(f"docs.`{text_col}`") == F.col("dropped.text_key"))
    return rows.join(dropped, met, "left_anti").select(*[F.col(f"docs.`{c}`") for c in docs.columns])


def _with_set(fetched: DataFrame, k: int) -> DataFrame:
    """The texts whose set is the node's.

    Where rows repeat an id with another text, the join by id also brings that text; where
    they repeat both, a text comes twice, which finds the same links twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, chunk in _chunks(batch["text"]):
                part = batch.iloc[start : start + len(chunk)]
                yield part[[_set_key(s) == sid for s, sid in zip(shingle_sets(chunk, k), part["sid"])]]

    return fetched.mapInPandas(run, "sid binary, text string")
