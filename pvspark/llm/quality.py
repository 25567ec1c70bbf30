"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios over the whole text. Each is cut into quantile
bins. Cyclic gradient boosting visits one feature after another and adds to its
look-up table (one value per bin) a shallow regression tree of the residuals;
after the single features, the pairs that explain most of what is left get a
coarse two-dimensional table each, boosted by trees of one cut a side. A score
is a sum of look-ups through a sigmoid, done for whole batches at once.

The model is fitted on a bounded sample of at most ``sample`` labelled rows
(``Params``), drawn by a hash; only their features reach the driver.

Results: one row per input row. Null and empty texts have all-zero features and
get a score like any other. Null labels are ignored; a label table may repeat
ids (each row counts). With no labels every score is 0.5. Repeated rows and
null ids each give their own row; extra columns are ignored.
"""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import per_row, pieces
from pvspark.llm.words import distinct, mix, shingles, word_hashes, word_starts

FEATURES = (
    "log_chars",
    "word_chars",
    "upper",
    "digit",
    "non_ascii",
    "sentence_ends",
    "bars",
    "shouts",
    "symbols",
    "line_ends",
    "distinct_words",
    "repeats_last",
    "distinct_triples",
    "short_words",
    "repeated_lines",
)


@dataclass(frozen=True)
class Params:
    sample: int = 10_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    leaves: int = 3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    cuts: tuple[np.ndarray, ...]
    tables: np.ndarray
    pair_cuts: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: np.ndarray
    bias: float


_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "sentence_ends": b".?",
    "bars": b"|",
    "shouts": b"!",
    "symbols": b"#$%&*+=<>{}[]\\^~_@",
    "line_ends": b"\n",
}


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row per text, a column per name in ``FEATURES``."""
    out = np.zeros((len(at) - 1, len(FEATURES)))
    put = lambda name, value: out.__setitem__((slice(None), FEATURES.index(name)), value)
    chars = per_row((data & 0xC0) != 0x80, at)
    some = np.maximum(chars, 1)
    put("log_chars", np.log1p(chars))
    for name, members in _CLASS.items():
        there = np.zeros(256, bool)
        there[list(members)] = True
        put(name, per_row(there[data], at) / some)
    put("non_ascii", per_row(data >= 0xC0, at) / some)
    hashed, words_at = word_hashes(data, at)
    n = np.maximum(np.diff(words_at), 1)
    put("word_chars", np.minimum(chars / n, 100))
    put("distinct_words", np.diff(distinct(hashed, words_at)[1]) / n)
    same = np.zeros(len(hashed), bool)
    same[1:] = hashed[1:] == hashed[:-1]
    same[words_at[:-1][words_at[:-1] < len(hashed)]] = False
    put("repeats_last", per_row(same, words_at) / n)
    three, three_at = shingles(hashed, words_at, 3)
    put("distinct_triples", np.diff(distinct(three, three_at)[1]) / np.maximum(np.diff(three_at), 1))
    space = np.flatnonzero((data == 32) | (data == 10))
    short = np.zeros(len(data), bool)
    if len(space) > 1:
        short[space[1:][np.diff(space) <= 4]] = True
    put("short_words", per_row(short, at) / n)
    line_edge = np.unique(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1]))
    line_edge = line_edge[line_edge < len(data)]
    if len(line_edge):
        # a line is summed up by its words' hashes in order
        order = np.arange(len(hashed), dtype=np.uint64)
        word_start = word_starts(data, at)
        line = np.searchsorted(line_edge, word_start, "right") - 1
        first = np.searchsorted(line, np.arange(len(line_edge)))
        place = order - first[line].astype(np.uint64)
        sums = np.zeros(len(line_edge), np.uint64)
        np.add.at(sums, line, mix(hashed + place * np.uint64(0x9E3779B97F4A7C15)))
        lines_at = np.searchsorted(line_edge, at)
        lines = np.maximum(np.diff(lines_at), 1)
        put("repeated_lines", 1 - np.diff(distinct(sums, lines_at)[1]) / lines)
    empty = chars == 0
    out[empty] = 0
    return out


def _all_features(texts: pa.Array) -> np.ndarray:
    found = [features(data, at) for _, data, at in pieces(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins, grown by the best cut until ``leaves``."""
    gain = lambda a, b: a * a / (b + 1.0)
    parts = [(0, len(g))]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            c = np.arange(a + 1, b)
            up = (
                gain(gs[c] - gs[a], hs[c] - hs[a])
                + gain(gs[b] - gs[c], hs[b] - hs[c])
                - gain(gs[b] - gs[a], hs[b] - hs[a])
            )
            k = int(up.argmax())
            if up[k] > best[0]:
                best = (up[k], (a, b), int(c[k]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove(best[1])
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = -(gs[b] - gs[a]) / (hs[b] - hs[a] + 1.0)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best single cut on each side of a two-way table: its gain and the four steps."""
    block = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = block(g), block(h)
    rows, cols = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    parts = []
    for c in (cg, ch):
        a = c[rows, cols]
        b = c[rows, -1] - a
        d = c[-1, cols] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    up = sum(a * a / (b + 1.0) for a, b in zip(*parts))
    i, j = np.unravel_index(int(up.argmax()), up.shape)
    step = np.zeros(g.shape)
    for k, where in enumerate(
        (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])
    ):
        step[where] = -parts[0][k][i, j] / (parts[1][k][i, j] + 1.0)
    return float(up[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, p: Params = Params()) -> Model:
    n, f = x.shape
    cuts = tuple(_cuts(x[:, k], p.bins) for k in range(f))
    pair_cuts = tuple(_cuts(x[:, k], p.pair_bins) for k in range(f))
    b = np.stack([np.searchsorted(cuts[k], x[:, k], "right") for k in range(f)])
    c = np.stack([np.searchsorted(pair_cuts[k], x[:, k], "right") for k in range(f)])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    tables = np.zeros((f, p.bins))
    z = np.full(n, bias)

    def residuals():
        prob = 1 / (1 + np.exp(-z))
        return prob - y, prob * (1 - prob)

    for _ in range(p.rounds):
        for k in range(f):
            g, h = residuals()
            step = p.rate * _tree(
                np.bincount(b[k], g, p.bins), np.bincount(b[k], h, p.bins), p.leaves
            )
            tables[k] += step
            z += step[b[k]]
    side = p.pair_bins
    two_way = lambda i, j, w: np.bincount(c[i] * side + c[j], w, side * side).reshape(side, side)
    g, h = residuals()
    gains = [
        (_quadrants(two_way(i, j, g), two_way(i, j, h))[0], i, j) for i, j in combinations(range(f), 2)
    ]
    pairs = tuple((i, j) for _, i, j in sorted(gains, reverse=True)[: p.pairs])
    pair_tables = np.zeros((len(pairs), side, side))
    for _ in range(p.pair_rounds):
        for k, (i, j) in enumerate(pairs):
            g, h = residuals()
            step = p.rate * _quadrants(two_way(i, j, g), two_way(i, j, h))[1]
            pair_tables[k] += step
            z += step[c[i], c[j]]
    return Model(cuts, tables, pair_cuts, pairs, pair_tables, bias)


def score(x: np.ndarray, m: Model) -> np.ndarray:
    z = np.full(len(x), m.bias)
    for k, cuts in enumerate(m.cuts):
        z += m.tables[k][np.searchsorted(cuts, x[:, k], "right")]
    for k, (i, j) in enumerate(m.pairs):
        z += m.pair_tables[k][
            np.searchsorted(m.pair_cuts[i], x[:, i], "right"),
            np.searchsorted(m.pair_cuts[j], x[:, j], "right"),
        ]
    return 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame, learn: Column, p: Params = Params()) -> Model | None:
    """``labels``: ``doc_id, quality``; rows of it where ``learn`` (on its doc_id) holds are learned."""
    usable = labels.select("doc_id", "quality").filter(
        learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
    )
    n = usable.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit(p.seed), "doc_id"), F.lit(1 << 20))
    chosen = usable.filter(draw < int((1 << 20) * min(1.0, 0.95 * p.sample / n))).limit(p.sample)

    def rows(batches):
        for batch in batches:
            x = _all_features(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "x"]
            )

    # at most ``sample`` rows of two numbers: small by its parameter
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = (
        joined.select(F.col("quality").cast("double").alias("quality"), "text")
        .mapInArrow(rows, "quality double, x binary")
        .collect()
    )
    if not found:
        return None
    found.sort(key=lambda r: (r["x"], r["quality"]))
    x = np.stack([np.frombuffer(r["x"]) for r in found])
    y = np.array([r["quality"] for r in found])
    if y.min() == y.max():
        return Model((), np.zeros((0, 1)), (), (), np.zeros((0, 1, 1)), 4.0 if y[0] else -4.0)
    return fit(x, y, p)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score``. The model is a few tables of fixed size, sent as a broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model and tuple(vars(model).values()))

    def run(batches):
        for batch in batches:
            if sent.value is None:
                value = np.full(len(batch), 0.5)
            else:
                value = score(_all_features(batch.column(1)), Model(*sent.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["doc_id", "score"])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, score double")
