"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line's features describe it and its two
neighbours; transitions let a label carry over to the next line. Labels are given for whole
documents, so training gives a document's label to each of its lines. Forward-backward
yields each line's marginal probability of being good, and a document's score is their mean
weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import word_hashes

#: Names of a line's own features, in the order of :func:`_own_features`'s columns.
FEATURES = (
    "one",
    "log_length",
    "log_words",
    "mean_word",
    "long_words",
    "letters",
    "capitals",
    "digits",
    "spaces",
    "stops",
    "symbols",
    "bars",
    "trailing_symbols",
    "repeated_neighbour",
    "repeated_word",
    "distinct_share",
    "repeated_line",
    "starts_capital",
    "ends_stop",
    "lone_marks",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?'\"()-"]] = True
_BAR = np.zeros(256, bool)
_BAR[ord("|")] = True
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK | _STOP | _BAR)


def _counts(table: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(table[buf], dtype=np.int64)))
    return (sums[ends] - sums[starts]).astype(np.float64)


def _own_features(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some documents, the lines' lengths, and lines per document."""
    lines_of = [d.split(b"\n") for d in data]
    per_doc = np.array([len(x) for x in lines_of])
    lines = [line for x in lines_of for line in x]
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    buf = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    count = lambda table: _counts(table, buf, starts, ends)
    size = np.maximum(length, 1).astype(np.float64)
    # words: their counts, repeats and lengths, by position in the buffer
    h, at = word_hashes(buf.tobytes())
    line_of = np.searchsorted(ends, at, "right")
    n_words = np.bincount(line_of, minlength=len(lines)).astype(np.float64)
    words = np.maximum(n_words, 1)
    edge = np.diff(np.concatenate(([False], ~_BLANK[buf], [False])).view(np.int8))
    last = np.flatnonzero(edge == -1)
    word_len = last - at
    mean_len = np.bincount(line_of, word_len, len(lines)) / words
    long_words = np.bincount(line_of, word_len > 20, len(lines)) / words
    tail = _SYMBOL[buf[last - 1]] & (word_len > 1) if len(at) else np.empty(0, bool)
    trailing = np.bincount(line_of, tail, len(lines)) / words
    lone = ~_LETTER[buf[at]] & ~_DIGIT[buf[at]] & (word_len == 1) if len(at) else np.empty(0, bool)
    lone_marks = np.bincount(line_of, lone, len(lines)) / words
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1]))) if len(h) else np.empty(0, bool)
    neighbour = np.bincount(line_of, same, len(lines)) / words
    order = np.lexsort((h, line_of))
    hs, ls = h[order], line_of[order]
    new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1]))) if len(h) else np.empty(0, bool)
    distinct = np.bincount(ls, new, len(lines))
    runs = np.flatnonzero(new)
    top = np.zeros(len(lines))
    if len(h):
        np.maximum.at(top, ls[runs], np.diff(np.concatenate((runs, [len(h)]))))
    # a line that its document has more than once
    seen = np.zeros(len(lines))
    base = 0
    for x in lines_of:
        if len(set(x)) < len(x):
            times: dict[bytes, int] = {}
            for line in x:
                times[line] = times.get(line, 0) + 1
            seen[base : base + len(x)] = [times[line] > 1 and bool(line) for line in x]
        base += len(x)
    first = buf[starts]
    final = buf[np.maximum(ends - 1, starts)]
    own = np.stack(
        [
            np.ones(len(lines)),
            np.log1p(length) / 5,
            np.log1p(n_words) / 4,
            np.minimum(mean_len, 40) / 10,
            long_words,
            count(_LETTER) / size,
            count(_CAPITAL) / size * 5,
            count(_DIGIT) / size,
            count(_BLANK) / size,
            count(_STOP) / size * 5,
            count(_SYMBOL) / size * 5,
            count(_BAR) / size * 5,
            trailing,
            neighbour,
            top / words,
            distinct / words,
            seen,
            _CAPITAL[first],
            _STOP[final],
            lone_marks,
        ],
        1,
    )
    return own, size, per_doc


def _with_neighbours(own: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after, and whether there is none."""
    ends = np.cumsum(per_doc)
    first, last = ends - per_doc, ends - 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate((own, before[:, 1:], after[:, 1:], (before[:, :1] == 0), (after[:, :1] == 0)), 1)


@dataclass
class Chain:
    """Weights of the good label against the bad one, and log-potentials of label pairs."""

    weights: np.ndarray
    pairs: np.ndarray  # [label, next label]

    def lines(self, own: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Log-potentials of both labels for each line; :func:`_with_neighbours` times the weights, without that matrix."""
        n = own.shape[1]
        here, before, after = self.weights[:n], self.weights[n : 2 * n - 1], self.weights[2 * n - 1 : 3 * n - 2]
        ends = np.cumsum(per_doc)
        first, last = ends - per_doc, ends - 1
        back, ahead = np.roll(own[:, 1:] @ before, 1), np.roll(own[:, 1:] @ after, -1)
        back[first], ahead[last] = self.weights[-2], self.weights[-1]
        unary = np.zeros((len(own), 2))
        unary[:, 1] = own @ here + back + ahead
        return unary


def _padded(values: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    longest = int(per_doc.max())
    mask = np.arange(longest)[None, :] < per_doc[:, None]
    out = np.zeros((len(per_doc), longest, *values.shape[1:]))
    out[mask] = values
    return out, mask


def forward_backward(unary: np.ndarray, per_doc: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the label 1 per line, expected label pairs per document, log-partition.

    ``unary`` holds the lines of all documents, one after another, with a log-potential per label.
    """
    u, mask = _padded(unary, per_doc)
    n, longest, _ = u.shape
    alpha, beta = np.empty_like(u), np.zeros_like(u)
    alpha[:, 0] = u[:, 0]
    for t in range(1, longest):
        step = np.logaddexp(alpha[:, t - 1, :1] + pairs[0], alpha[:, t - 1, 1:] + pairs[1]) + u[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    counts = np.zeros((n, 2, 2))
    for t in range(longest - 2, -1, -1):
        ahead = u[:, t + 1] + beta[:, t + 1]
        step = np.logaddexp(pairs[:, 0] + ahead[:, :1], pairs[:, 1] + ahead[:, 1:])
        inside = mask[:, t + 1]
        beta[:, t] = np.where(inside[:, None], step, 0)
        joint = alpha[:, t, :, None] + pairs[None] + ahead[:, None, :] - log_z[:, None, None]
        counts += np.where(inside[:, None, None], np.exp(np.minimum(joint, 0)), 0)
    marginal = np.exp(np.minimum(alpha[..., 1] + beta[..., 1] - log_z[:, None], 0))
    return marginal[mask], counts, log_z


def train(texts: list[str], labels: list[int], prior: float = 0.5, steps: int = 160, rate: float = 0.2, decay: float = 1e-3) -> Chain:
    """Maximum likelihood with Adam.

    Documents of a label weigh the same, and those of label 1 weigh ``prior`` in all, so a
    sample that has labels in other shares than the corpus still gives its odds.
    """
    own, _, per_doc = _own_features([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    x = _with_neighbours(own, per_doc)
    y = np.array(labels)
    # documents of like length go together, so padding stays small
    order = np.argsort(per_doc, kind="stable")
    ends = np.cumsum(per_doc)
    groups = []
    for part in np.array_split(order, max(1, len(order) // 256)):
        rows = np.concatenate([np.arange(ends[d] - per_doc[d], ends[d]) for d in part])
        groups.append((x[rows], per_doc[part], y[part]))
    good, bad = prior / max(1, int((y == 1).sum())), (1 - prior) / max(1, int((y == 0).sum()))
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = decay * theta
        pairs = theta[-4:].reshape(2, 2)
        for gx, n, gy in groups:
            weight = np.where(gy == 1, good, bad) / n
            unary = np.zeros((len(gx), 2))
            unary[:, 1] = gx @ theta[:-4]
            marginal, counts, _ = forward_backward(unary, n, pairs)
            line_weight, line_label = np.repeat(weight, n), np.repeat(gy, n)
            grad[:-4] += gx.T @ ((marginal - line_label) * line_weight)
            true = np.zeros((len(n), 2, 2))
            true[np.arange(len(n)), gy, gy] = n - 1
            grad[-4:] += ((counts - true) * weight[:, None, None]).sum(0).ravel()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


def score_texts(texts: list[str | None], chain: Chain) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, for each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    own, size, per_doc = _own_features(data)
    unary = chain.lines(own, per_doc)
    order = np.argsort(per_doc, kind="stable")
    ends = np.cumsum(per_doc)
    scores = np.empty(len(texts))
    # documents of like length together: at most twice the lines are padding
    cuts = [0]
    for i in range(1, len(order)):
        if per_doc[order[i]] > 2 * per_doc[order[cuts[-1]]]:
            cuts.append(i)
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        part = order[lo:hi]
        rows = np.concatenate([np.arange(ends[d] - per_doc[d], ends[d]) for d in part])
        marginal, _, _ = forward_backward(unary[rows], per_doc[part], chain.pairs)
        doc = np.repeat(np.arange(len(part)), per_doc[part])
        scores[part] = np.bincount(doc, marginal * size[rows]) / np.bincount(doc, size[rows])
    return np.clip(scores, 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int, max_chars: int) -> tuple[DataFrame, float]:
    """``_id, _t, _y, _order``: at most ``limit`` labelled texts of at most ``max_chars`` characters, half of either
    label where there are enough, and the share of label 1 among all labels.

    Which texts are taken depends on their ids alone.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null").dropDuplicates(["_id"])
    rows = marked.withColumn("_order", F.xxhash64("_id"))
    chosen = rows.filter("_y = 1").orderBy("_order", "_id").limit(limit // 2).union(rows.filter("_y = 0").orderBy("_order", "_id").limit(limit // 2))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull() & (F.length("_t") <= max_chars))
    # one text an id, so that repeated ids do not widen the sample
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y"), F.first("_order").alias("_order"))
    share = marked.agg(F.avg("_y")).first()[0]
    return found, share


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    limit: int = 2400,
    max_chars: int = 20_000,
) -> Chain | None:
    """Train on a bounded sample of labelled rows: ``limit`` documents of up to ``max_chars``.

    Null where the sample lacks one of the two labels. Labels are of documents, so each of
    a document's lines learns from its document's label, and the pair potentials learn from
    them that neighbours agree. Of texts that share an id the least counts. The sample's
    texts and features stay in one task; the driver gets the weights.
    """
    sample, share = labelled_sample(docs, labels, id_col, text_col, label_col, limit, max_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for b in batches for r in zip(b["_order"], b["_t"], b["_y"])), key=lambda r: r[:2])
        if len({y for _, _, y in rows}) == 2:
            chain = train([t for _, t, _ in rows], [int(y) for _, _, y in rows], share)
            yield pd.DataFrame({"weights": [chain.weights], "pairs": [chain.pairs.ravel()]})

    found = sample.select("_order", "_t", "_y").repartition(1).mapInPandas(run, "weights array<double>, pairs array<double>").collect()
    return Chain(np.array(found[0]["weights"]), np.array(found[0]["pairs"]).reshape(2, 2)) if found else None


#: Texts that are scored together, at most, in characters (a longer one goes alone).
CHUNK_CHARS = 1_000_000


def score(docs: DataFrame, chain: Chain | None, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``out``: a number from 0 to 1, higher for better.

    Null and empty texts are one empty line and get its score. Without a model every score
    is 0.5. Equal texts and repeated rows have equal scores, and an empty table gives no
    rows. Long texts are scored whole; memory grows with the lines of the longest. Other
    columns pass through, of whatever names; one called ``out`` is replaced.
    """
    if chain is None:
        return docs.withColumn(out, F.lit(0.5))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, scores, start, chars = batch.tolist(), [], 0, 0
            for i, t in enumerate([*texts, None]):
                n = len(t) if t else 0
                if i > start and (i == len(texts) or chars + n > CHUNK_CHARS):
                    scores.append(score_texts(texts[start:i], chain))
                    start, chars = i, 0
                chars += n
            yield pd.Series(np.concatenate(scores) if scores else np.empty(0))

    return docs.withColumn(out, run(F.col(text_col)))
