"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into chunks at places that no piece can span, and each distinct chunk of the
corpus is encoded once: its substrings of bounded length are exploded, joined to the piece
table, and grouped by chunk again into the lattice of pieces, over which a higher-order
``aggregate`` folds the encoding.

* For a unigram model the fold is Viterbi's: best score for each end position.
* For a BPE model, Viterbi over scores gives other ids than the model defines, as scores
  are merge ranks and do not add up. There the fold visits the lattice's edges in order of
  rank and applies each that joins exactly two current symbols.

A chunk that does not fit into the bits of a long would make as many rows, each with the
whole chunk, as it has characters; such chunks are folded by the same rule in place.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stash_buckets

SPACE = "▁"
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """What the operators need of a SentencePiece model file."""

    kind: int
    pieces: list[tuple[str, int, float]]  # ordinary pieces: text, id, score
    texts: list[bytes]  # what each id decodes to, before white space is restored
    byte_ids: list[int]
    unknown: int
    dummy_prefix: bool
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max((len(p) for p, _, _ in self.pieces), default=1)
        self.cut = _cut_pattern([p for p, _, _ in self.pieces])


def load_model(path: str) -> Model:
    """Read a model file on the driver; its size is that of a vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for number, value in _fields(sp.serialized_model_proto()):
        if number in (2, 3):
            (trainer if number == 2 else normalizer).update(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models that keep texts as they are, with escaped white space, are supported")
    pieces, texts, byte_ids = [], [], [-1] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            texts.append(b"" if sp.is_control(i) else " ⁇ ".encode())
        else:
            texts.append(piece.encode())
            if not sp.is_unused(i):
                pieces.append((piece, i, sp.get_score(i)))
    return Model(kind, pieces, texts, byte_ids, sp.unk_id(), bool(normalizer.get(3, 1)))


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def _cut_pattern(pieces: list[str]) -> str:
    """A pattern of the places where texts may be cut: no piece spans any of them.

    Before white space that follows something else, and between a Latin letter and an ASCII
    character that is none, as far as the vocabulary allows.
    """
    latin, other = re.compile(f"[{_LETTERS}]"), re.compile(r"[\x00-@\[-`{-\x7f]")
    spans = {"ls": False, "lo": False, "ol": False}
    for p in pieces:
        for a, b in zip(p, p[1:]):
            spans["ls"] |= a != SPACE and b == SPACE
            spans["lo"] |= bool(latin.match(a) and other.match(b))
            spans["ol"] |= bool(other.match(a) and latin.match(b))
    ascii_other = r"\x00-@\[-`{-\x7f"
    cuts = [
        ("ls", f"(?<=[^{SPACE}])(?={SPACE})"),
        ("lo", f"(?<=[{_LETTERS}])(?=[{ascii_other}])"),
        ("ol", f"(?<=[{ascii_other}])(?=[{_LETTERS}])"),
    ]
    return "|".join(pattern for name, pattern in cuts if not spans[name]) or r"(?!)"


def _chunker(model: Model):
    """A function from a text to its chunks, with white space escaped."""
    # Runs are much faster to find than the places between them; where all three cuts hold
    # and a text is of nothing but these runs, both give the same chunks.
    cut = re.compile(model.cut)
    runs = re.compile(f"{SPACE}*[{_LETTERS}]+|{SPACE}*[\\x00-@\\[-`{{-\\x7f]+|{SPACE}+")
    plain = re.compile(f"[\\x00-\\x7f{_LETTERS}{SPACE}]*")
    fast = model.cut.count("|") == 2

    def chunks(text: str | None) -> list[str]:
        if not text:
            return []
        text = (SPACE if model.dummy_prefix else "") + text.replace(" ", SPACE)
        if fast and plain.fullmatch(text):
            return runs.findall(text)
        return [c for c in cut.split(text) if c]

    return chunks


#: Chunks of at most so many characters are folded as the bits of a long.
SHORT = 61
#: Stands in a text's codes for a chunk that the dictionary does not hold.
RARE = 65_535


def _count_chunks(texts: DataFrame, model: Model, most: int = 100_000) -> DataFrame:
    """``chunk, n`` with partial counts; a task holds ``most`` different chunks at a time."""
    make = _chunker(model)

    def frame(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pd.Series(list(counts), dtype=object), "n": list(counts.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(make(text))
                if len(counts) > most:
                    yield frame(counts)
                    counts.clear()
        yield frame(counts)

    return texts.mapInPandas(run, "chunk string, n long")


def _power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _pack(rank: Column, start: Column, length: Column) -> Column:
    """Rank, place and length in one long; a sort orders by rank, then place."""
    return F.shiftleft(rank.cast("long"), 43) + F.shiftleft(start.cast("long"), 8) + length.cast("long")


def _start(edge: Column) -> Column:
    return F.shiftright(edge, 8).bitwiseAND(F.lit((1 << 35) - 1)).cast("int")


def _length(edge: Column) -> Column:
    return edge.bitwiseAND(F.lit(255)).cast("int")


def _merge_fold(size: Column, edges: Column) -> Column:
    """Marks of a chunk's symbols after all merges of a BPE model: bit i is set where a symbol starts or ends.

    ``edges`` are packed by :func:`_pack`, so their order is by rank, then by place. An edge
    applies if its ends are marked and exactly one mark lies between them, which it clears.
    """

    def step(marks: Column, edge: Column) -> Column:
        s, n = _start(edge), _length(edge)
        inside = marks.bitwiseAND(F.call_function("shiftleft", _power(n - 1) - 1, s + 1))
        ends = F.call_function("shiftleft", _power(n) + 1, s)
        alone = (inside != 0) & (inside.bitwiseAND(inside - 1) == 0)
        return F.when(alone & (marks.bitwiseAND(ends) == ends), marks - inside).otherwise(marks)

    return F.aggregate(F.sort_array(edges), _power(size + 1) - 1, step)


def _viterbi_fold(edges: Column) -> Column:
    """Marks of the best path of a unigram lattice, as in :func:`_merge_fold`.

    ``edges`` are ``struct<end, back, score>``, with ``back`` the length below 0; each place
    is the end of one of length 1. In their order each is visited once, so that one comes
    last of its place's: the state holds the best score and the marks of its path for every
    place so far, and ``top`` for the next, and an array is copied once for each place. Of
    equal scores the path with the later marks wins.
    """
    path = "struct<score:double,marks:long>"
    start = F.struct(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("marks"))).alias("paths"), F.lit(None).alias("top"))

    def step(state: Column, edge: Column) -> Column:
        before = F.element_at(state["paths"], edge["end"] + edge["back"] + 1)
        reached = F.struct((before["score"] + edge["score"]).alias("score"), before["marks"].bitwiseOR(_power(edge["end"])).alias("marks"))
        top = F.greatest(state["top"], reached)  # passes over null
        last = F.struct(F.concat(state["paths"], F.array(top)).alias("paths"), F.lit(None).cast(path).alias("top"))
        return F.when(edge["back"] == -1, last).otherwise(F.struct(state["paths"].alias("paths"), top.alias("top")))

    return F.aggregate(F.sort_array(edges), start.cast(f"struct<paths:array<{path}>,top:{path}>"), step, lambda s: F.element_at(s["paths"], -1)["marks"])


def _unknown_score(model: Model) -> float:
    """As in the library, a character outside the vocabulary costs 10 below the worst piece."""
    return min((s for _, _, s in model.pieces), default=0.0) - 10.0


def fold_chunks(chunks: DataFrame, model: Model) -> DataFrame:
    """``g, chunk, marks`` from distinct ``g, chunk``: the lattice, relationally.

    Substrings of bounded length are exploded and joined to the piece table, the edges are
    grouped by chunk, and a fold over them marks where the chunk's symbols start and end.
    Rows of one ``g`` must be in one partition, so that nothing is exchanged here. Chunks
    are of at most :data:`SHORT` characters; those without any edge are left out. In a
    unigram lattice a character that is no piece has an edge too, which costs
    :func:`_unknown_score`.
    """
    spark = chunks.sparkSession
    shortest = 1 if model.kind == UNIGRAM else 2
    by_rank = sorted(model.pieces, key=lambda p: (-p[2], p[1]))
    table = [(p, rank, score) for rank, (p, _, score) in enumerate(by_rank) if len(p) >= shortest]
    # the vocabulary is a model's, of bounded size whatever the corpus
    pieces = F.broadcast(spark.createDataFrame(pd.DataFrame(table, columns=["piece", "rank", "score"]), "piece string, rank int, score double"))
    size, start, length = F.length("chunk"), F.col("start"), F.col("length")
    edges = (
        chunks.filter(size >= shortest)
        .select("g", "chunk", F.explode(F.sequence(F.lit(0), size - shortest)).alias("start"))
        .select("g", "chunk", "start", F.explode(F.sequence(F.lit(shortest), F.least(size - start, F.lit(model.longest)))).alias("length"))
        .withColumn("piece", F.col("chunk").substr(start + 1, length))
        .join(pieces, "piece", "left" if model.kind == UNIGRAM else "inner")
    )
    if model.kind == BPE:
        edge = _pack(F.col("rank"), start, length)
        marks = _merge_fold(size, F.col("edges"))
    else:
        edges = edges.filter(F.col("score").isNotNull() | (length == 1))
        score = F.coalesce("score", F.lit(_unknown_score(model)))
        edge = F.struct((start + length).alias("end"), (-length).alias("back"), score.alias("score"))
        marks = _viterbi_fold(F.col("edges"))
    return edges.groupBy("g", "chunk").agg(F.collect_list(edge).alias("edges")).select("g", "chunk", marks.alias("marks"))


def _merged(chunk: str, ranks: dict[str, int]) -> list[str]:
    """What :func:`_merge_fold` finds, for a chunk of any length: a queue of merges over a linked list."""
    symbols, before, after = list(chunk), list(range(-1, len(chunk) - 1)), list(range(1, len(chunk) + 1))
    queue = [(ranks[a + b], i, a + b) for i, (a, b) in enumerate(zip(chunk, chunk[1:])) if a + b in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, piece = heapq.heappop(queue)
        j = after[i]
        if symbols[i] is None or j >= len(symbols) or symbols[i] + symbols[j] != piece:
            continue
        symbols[i], symbols[j], after[i] = piece, None, after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(symbols) and (rank := ranks.get(both := symbols[k] + symbols[after[k]])) is not None:
                heapq.heappush(queue, (rank, k, both))
    return [s for s in symbols if s is not None]


def _best_path(chunk: str, scores: dict[str, float], longest: int, unknown_score: float) -> list[str]:
    """What :func:`_viterbi_fold` finds, for a chunk of any length."""
    best, back = [0.0], [0]
    for end in range(1, len(chunk) + 1):
        top, at = -math.inf, end - 1
        for start in range(max(0, end - longest), end):
            score = scores.get(chunk[start:end], unknown_score if start == end - 1 else None)
            if score is not None and best[start] + score >= top:
                top, at = best[start] + score, start
        best.append(top)
        back.append(at)
    out, end = [], len(chunk)
    while end:
        out.append(chunk[back[end] : end])
        end = back[end]
    return out[::-1]


class _Speller:
    """Ids of chunks, from the marks that the lattice's fold has set."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {p: (i,) for p, i, _ in model.pieces}
        by_rank = sorted(model.pieces, key=lambda p: (-p[2], p[1]))
        self.ranks = {p: rank for rank, (p, _, _) in enumerate(by_rank)}
        self.scores = {p: s for p, _, s in model.pieces}

    def symbol(self, s: str) -> tuple[int, ...]:
        """A piece's id, or those of the bytes of a character outside the vocabulary."""
        ids = self.known.get(s)
        if ids is None:
            spelled = min(self.model.byte_ids) >= 0
            ids = tuple(self.model.byte_ids[b] for b in s.encode()) if spelled else (self.model.unknown,)
        return ids

    def ids(self, chunk: str, marks: int | None) -> tuple[int, ...]:
        """``marks`` is None for a chunk without edges and for one of more than SHORT characters."""
        if marks is None:
            if len(chunk) <= SHORT:
                symbols: list[str] = list(chunk)
            elif self.model.kind == BPE:
                symbols = _merged(chunk, self.ranks)
            else:
                symbols = _best_path(chunk, self.scores, self.model.longest, _unknown_score(self.model))
        else:
            symbols, at, rest = [], 0, marks >> 1
            while rest:
                width = (rest & -rest).bit_length()
                symbols.append(chunk[at : at + width])
                at, rest = at + width, rest >> width
        return tuple(i for s in symbols for i in self.symbol(s))


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start : start + size]`` of all pairs, one after the other."""
    if not len(sizes):
        return values[:0]
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


@dataclass
class _Dictionary:
    codes: dict[str, int]
    sizes: np.ndarray
    ids: np.ndarray


def _dictionary(texts: DataFrame, model: Model, most: int, parts: int) -> _Dictionary:
    """The most frequent chunks of ``texts`` with their ids; at most ``most``, which bounds what is broadcast."""
    spark = texts.sparkSession
    counted = _count_chunks(texts, model).filter(F.length("chunk") <= SHORT).groupBy("chunk").agg(F.sum("n").alias("n"))
    chunks = [r["chunk"] for r in counted.orderBy(F.desc("n"), "chunk").limit(min(most, RARE)).collect()]
    marks: dict[str, int] = {}
    if chunks:
        top = spark.createDataFrame(pd.DataFrame({"chunk": chunks}), "chunk string")
        dealt = top.select(F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("g"), "chunk").repartition(parts, "g")
        marks = {r["chunk"]: r["marks"] for r in fold_chunks(dealt, model).collect()}
    speller = _Speller(model)
    spelled = [speller.ids(c, marks.get(c)) for c in chunks]
    flat = np.fromiter((i for ids in spelled for i in ids), np.int32)
    return _Dictionary({c: k for k, c in enumerate(chunks)}, np.fromiter(map(len, spelled), np.int64), flat)


def _blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of at most ``most`` characters of texts of these sizes; a longer text is one alone."""
    start, chars = 0, 0
    for i, n in enumerate(sizes):
        if i > start and chars + n > most:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(sizes):
        yield start, len(sizes)


def _coded(texts: list[str | None], make: Callable, codes: dict[str, int], groups: int) -> tuple[list[bytes], list[bytes], list[dict]]:
    """Of one block's texts the codes of their chunks, the references to rare ones, and these by group.

    A reference counts the block's rare chunks by group, then in order.
    """
    rare: dict[str, int] = {}
    coded, firsts = [], []
    for text in texts:
        chunks = make(text)
        code = np.fromiter((codes.get(c, RARE) for c in chunks), np.uint16, len(chunks))
        firsts.append(np.fromiter((rare.setdefault(chunks[i], len(rare)) for i in np.flatnonzero(code == RARE).tolist()), np.int64))
        coded.append(code.astype("<u2").tobytes())
    order = sorted((zlib.crc32(c.encode("utf-8", "surrogatepass")) % groups, c, at) for c, at in rare.items())
    place = np.empty(len(order), "<u4")
    place[[at for _, _, at in order]] = np.arange(len(order))
    parts: list[dict] = []
    for g, chunk, _ in order:
        if not parts or parts[-1]["g"] != g:
            parts.append({"g": g, "words": []})
        parts[-1]["words"].append(chunk)
    return coded, [place[f].tobytes() for f in firsts], parts


def encode(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    carry: list[str] | None = None,
    dictionary: int = RARE,
    sample_chars: int = 8_000_000,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) with ``ids`` (``array<int>``) and ``n_tokens``.

    The ids are those that the SentencePiece library gives for the whole text, without
    control symbols, which are ordinary text here. Null and empty texts have no ids, equal
    texts and repeated rows equal ones; long texts and long chunks cost in proportion to
    their length. An empty table gives no rows. Carried columns called ``ids`` or
    ``n_tokens`` are replaced, and other names cannot clash.

    The dictionary, at most ``dictionary`` chunks, is taken from about ``sample_chars``
    characters of texts; it decides which chunks travel, and changes no result. All other
    chunks of the corpus go through the lattice once each: texts are coded in blocks of
    ``block_chars`` characters, a block's distinct rare chunks are dealt out by group, folded
    there, and their ids come back to the block, which is kept as a bucketed table so that
    it does not travel itself.
    """
    spark: SparkSession = docs.sparkSession
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("ids", "n_tokens")]
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    sampled = base.select("text").filter(F.rand(7) < min(1.0, sample_chars / max(chars, 1)))
    table = _dictionary(sampled, model, dictionary, n)
    known = spark.sparkContext.broadcast(table)
    groups, make = max(4 * n, chars // 4_000_000), _chunker(model)
    rows = [f for f in base.schema.fields if f.name != "text"]
    part = "array<struct<g:int,words:array<string>>>"
    stored = StructType([*rows, *StructType.fromDDL(f"block long, codes binary, refs binary, parts {part}").fields])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, end in _blocks(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), block_chars):
                size, kept = end - start, batch.slice(start, end - start)
                coded, refs, parts = _coded(kept.column("text").to_pylist(), make, known.value.codes, groups)
                columns = {f.name: kept.column(f.name) for f in rows} | {
                    "block": pa.array([block] * size, pa.int64()),
                    "codes": pa.array(coded, pa.binary()),
                    "refs": pa.array(refs, pa.binary()),
                    "parts": pa.array([parts] + [None] * (size - 1), pa.list_(pa.struct([("g", pa.int32()), ("words", pa.list_(pa.string()))]))),
                }
                yield pa.RecordBatch.from_pydict(columns)
                block += 1

    blocks = stash_buckets(base.mapInArrow(code, stored), "sp-blocks", n, "block")
    # a table's columns may all be null, and so may what they hold
    read = [f for f in blocks.schema.fields if f.name in base.columns]
    words = blocks.filter("parts is not null").select("block", F.explode("parts").alias("p")).select("block", "p.g", "p.words").repartition(n, "g")
    # with all columns in use and no filter to push down, this branch reads the same exchange as the next
    first = words.select("g", "block", F.explode_outer("words").alias("chunk")).filter(F.length("chunk") <= SHORT).groupBy("g", "chunk").agg(F.min("block").alias("first"))
    distinct = first.filter("first is not null").select("g", "chunk")
    width = "<u2" if len(model.texts) <= 1 << 16 else "<u4"

    spellers = spark.sparkContext.broadcast(_Speller(model))

    def spell(folded: pa.Table, wanted: pa.Table) -> pa.Table:
        speller = spellers.value
        marks = dict(zip(folded["chunk"].to_pylist(), folded["marks"].to_pylist()))
        done: dict[str, tuple[int, ...]] = {}
        sizes, ids = [], []
        for chunks in wanted["words"].to_pylist():
            found = []
            for c in chunks:
                if (one := done.get(c)) is None:
                    one = done[c] = speller.ids(c, marks.get(c))
                found.append(one)
            sizes.append(np.fromiter(map(len, found), "<u4").tobytes())
            ids.append(np.fromiter((i for one in found for i in one), width).tobytes())
        return pa.table({"block": wanted["block"], "g": wanted["g"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    answers = fold_chunks(distinct, model).withColumnRenamed("g", "own").groupBy("own").cogroup(words.groupBy("g")).applyInArrow(spell, "block long, g int, sizes binary, ids binary")

    def assemble(coded: pa.Table, found: pa.Table) -> pa.Table:
        frequent = known.value
        found = found.sort_by("g")
        of = lambda t, c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        sizes = np.concatenate((frequent.sizes, of(found, "sizes", "<u4")), dtype=np.int32)
        ids = np.concatenate((frequent.ids, of(found, "ids", width)), dtype=np.int32)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        out, counts = [], []
        for codes, refs in zip(coded["codes"].to_pylist(), coded["refs"].to_pylist()):
            at = np.frombuffer(codes, "<u2").astype(np.int64)
            at[at == RARE] = np.frombuffer(refs, "<u4").astype(np.int64) + len(frequent.sizes)
            out.append(_gather(ids, starts[at], sizes[at]))
            counts.append(len(out[-1]))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        lists = pa.LargeListArray.from_arrays(bounds, np.concatenate([ids[:0], *out])).cast(pa.list_(pa.int32()))
        columns = {f.name: coded[f.name] for f in read} | {"ids": lists, "n_tokens": pa.array(np.diff(bounds), pa.int64())}
        return pa.table(columns)

    result = StructType([*read, *StructType.fromDDL("ids array<int>, n_tokens long").fields])
    out = blocks.drop("parts").groupBy("block").cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(assemble, result)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "ids", "n_tokens")


def decode(rows: DataFrame, model: Model, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that ``ids_col`` stands for; null ids give null, no ids an empty text.

    Control ids stand for nothing, ids outside the vocabulary for nothing too, and bytes
    that form no character for U+FFFD. Other columns pass through; one called ``out`` is
    replaced.
    """
    # pieces as the hex of their bytes, a literal of the vocabulary's size
    spelled = F.split(F.lit(",".join(t.hex() for t in model.texts)), ",")
    told = F.unhex(F.array_join(F.transform(ids_col, lambda i: F.get(spelled, i)), ""))
    text = F.make_valid_utf8(told.cast("string"))
    if model.dummy_prefix:
        text = F.regexp_replace(text, rf"\A{SPACE}", "")
    return rows.withColumn(out, F.replace(text, F.lit(SPACE), F.lit(" ")))


def as_unigram(model: Model) -> Model:
    """The same pieces as a unigram model: by Zipf's law the k-th best piece has a probability like 1 / k."""
    by_rank = sorted(model.pieces, key=lambda p: (-p[2], p[1]))
    norm = math.log(sum(1 / (k + 1) for k in range(len(by_rank))))
    return replace(model, kind=UNIGRAM, pieces=[(p, i, -math.log(k + 1) - norm) for k, (p, i, _) in enumerate(by_rank)])
