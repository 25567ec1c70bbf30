"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is its UTF-8 bytes with A-Z lower-cased and everything but letters and
non-ASCII bytes as a space. Its subwords are all byte 3- and 4-grams whose inner
bytes are no spaces, hashed to ``buckets``. The text's vector is the mean of its
subwords' embeddings; a linear softmax gives the languages. Both are trained
together by stochastic gradient descent in numpy on a bounded sample: at most
``per_language`` labelled texts of each language, each text whole.

As the mean is linear, embedding times softmax weights is one table of a score
per bucket and language; scoring is a look-up and a sum.

Calibration: a fifth of the sample is kept from training, and a temperature is
fitted there. A softmax is sure of texts in no learned language too, so what
rejects is how familiar a text is: the mean, over its subwords, of the log of
their frequency in the predicted language against an even spread. The threshold
lies halfway between what only a share ``risk`` of the kept texts stay below and
the mean of noise (subwords spread evenly). Few subwords vary more, so each
length (fourfold classes of their number) has its own; the beginnings of the
kept texts, of ``CROPS`` bytes, stand for shorter ones.

Results: one row per input row. A null text, or one without any letter, is
``und`` with score 0 and is rejected. Null labels are not learned from. With no
labelled text at all every text is ``und``. Repeated rows and null ids each give
their own row; extra columns are ignored.
"""

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import pieces

UND = "und"
CROPS = (4, 8, 16, 64, 256, 1024)
CLASSES = 16
SCORED = 1 << 18  # bytes of text scored at once


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 15
    dim: int = 16
    per_language: int = 500
    epochs: int = 6
    batch: int = 16
    rate: float = 0.5
    risk: float = 0.001
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (buckets + 1, 2 * languages): scores, then familiarity; the last row, of no subword, is 0
    bias: np.ndarray
    thresholds: np.ndarray  # of each class of lengths


_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, at: np.ndarray, buckets: int):
    """For both lengths: the bucket of the gram that starts at each byte (``buckets``: none)."""
    n = len(data)
    b = np.full(n + 4, 32, np.uint32)
    b[:n] = _FOLD[data]
    left = np.zeros(n, np.int64)
    left[:] = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    solid = b != 32
    three = (b[:n] << np.uint32(16)) | (b[1 : n + 1] << np.uint32(8)) | b[2 : n + 2]
    four = (three << np.uint32(8)) | b[3 : n + 3]
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out = []
    for value, size, salt in ((three, 3, 0x9E3779B1), (four, 4, 0x85EBCA6B)):
        ok = solid[1 : n + 1] & (left >= size)
        if size == 4:
            ok &= solid[2 : n + 2]
        h = value * np.uint32(salt)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        out.append(np.where(ok, h >> shift, np.uint32(buckets)))
    return out


def _sample(docs: DataFrame, learn: Column, p: Params) -> tuple[tuple[str, ...], list]:
    """Per language a pseudo-random share of its texts as sparse bucket counts; bounded by ``Params``."""
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return (), []
    share = F.create_map(
        *[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 0.95 * p.per_language / n))]
    )
    draw = F.pmod(F.xxhash64(F.lit(p.seed), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.filter(draw < share[F.col("lang")]).limit(p.per_language * len(counts))

    def sparse(batches):
        for batch in batches:
            langs, idx, val = batch.column(0), [], []
            for _, data, at in pieces(batch.column(1)):
                grams = np.concatenate(subwords(data, at, p.buckets))
                text = np.tile(np.repeat(np.arange(len(at) - 1), np.diff(at)), 2)
                end = np.concatenate([np.arange(len(data)) + 3, np.arange(len(data)) + 4]) - at[text]
                made = [([], []) for _ in at[1:]]
                for size in (None, *CROPS):
                    ok = grams < p.buckets
                    if size:
                        ok &= (end <= size) & (np.diff(at)[text] > size)
                    key, n = np.unique(text[ok].astype(np.int64) * p.buckets + grams[ok], return_counts=True)
                    cut = np.searchsorted(key, np.arange(len(at)) * p.buckets)
                    for (i, v), a, e in zip(made, cut[:-1], cut[1:]):
                        i.append((key[a:e] % p.buckets).astype(np.int32).tobytes())
                        v.append(n[a:e].astype(np.float32).tobytes())
                idx += [i for i, _ in made]
                val += [v for _, v in made]
            kind = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([langs, pa.array(idx, kind), pa.array(val, kind)], ["lang", "idx", "val"])

    kinds = "lang string, idx array<binary>, val array<binary>"
    rows = chosen.select("lang", "text").mapInArrow(sparse, kinds).collect()
    languages = tuple(sorted(counts))
    known = {k: i for i, k in enumerate(languages)}

    def read(lang, idx, val):
        n = np.frombuffer(val, np.float32)
        return lang, np.frombuffer(idx, np.int32), n / max(1, n.sum()), int(n.sum())

    found = [
        (*read(known[r["lang"]], r["idx"][0], r["val"][0]), [read(known[r["lang"]], i, v) for i, v in zip(r["idx"][1:], r["val"][1:]) if i])
        for r in rows
        if r["idx"][0]
    ]
    return languages, sorted(found, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(sample: list, classes: int, p: Params):
    """Minibatch gradient descent on cross-entropy; classes are weighted to equal shares."""
    rng = np.random.default_rng(p.seed)
    embed = rng.normal(0, 0.1, (p.buckets, p.dim)).astype(np.float32)
    weight = rng.normal(0, 0.1, (p.dim, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    y = np.array([s[0] for s in sample])
    by_class = len(y) / classes / np.maximum(1, np.bincount(y, minlength=classes))
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        order = rng.permutation(len(sample))
        for start in range(0, len(order), p.batch):
            chosen = order[start : start + p.batch]
            idx = np.concatenate([sample[i][1] for i in chosen])
            val = np.concatenate([sample[i][2] for i in chosen])
            size = np.array([len(sample[i][1]) for i in chosen])
            first = np.cumsum(size) - size
            mean = np.add.reduceat(embed[idx] * val[:, None], first)
            error = _softmax(mean @ weight + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error *= (by_class[y[chosen]] / len(chosen)).astype(np.float32)[:, None]
            to_mean = error @ weight.T
            weight -= rate * (mean.T @ error)
            bias -= rate * error.sum(axis=0)
            # a mean spreads its gradient thinly over its subwords; the step makes up for that
            step = np.repeat(to_mean, size, axis=0) * val[:, None]
            np.subtract.at(embed, idx, 100 * rate * step)
    return embed @ weight, bias


def _logits(sample: list, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.stack([(table[i] * v[:, None]).sum(axis=0) + bias for _, i, v, *_ in sample])


def _length_class(grams) -> np.ndarray:
    return np.minimum((np.frexp(np.maximum(grams, 1))[1] - 1) // 2, CLASSES - 1)


def _familiarity(sample: list, languages: int, buckets: int) -> np.ndarray:
    """Per bucket and language the log of its smoothed frequency against an even spread."""
    count = np.full((buckets, languages), 0.5)
    for lang, idx, share, n, *_ in sample:
        count[idx, lang] += share * n
    return np.log(count / count.sum(axis=0)) + np.log(buckets)


def _thresholds(familiar: np.ndarray, length: np.ndarray, risk: float) -> np.ndarray:
    """Per class the quantile of the values there; a class without any takes that of the next shorter one.

    With fewer than ``1 / risk`` texts the sample ends before the quantile, and its least value rejects more than
    ``risk``; it is then the bound of a next text's value under a normal distribution (Student's t) if that is lower.
    """
    out = np.full(CLASSES, -np.inf)
    for c in range(CLASSES):
        own = familiar[length == c]
        out[c] = np.quantile(own, risk) if len(own) > 1 else out[max(c - 1, 0)]
        if len(own) > 1 and len(own) * risk < 1:
            z = NormalDist().inv_cdf(risk)
            t = z + (z**3 + z) / 4 / (len(own) - 1)
            out[c] = min(own.min(), own.mean() + t * own.std(ddof=1) * np.sqrt(1 + 1 / len(own)))
    return out


def train(docs: DataFrame, learn: Column, p: Params = Params()) -> Model:
    """Learns from ``lang`` and ``text`` of the rows where ``learn`` holds."""
    languages, sample = _sample(docs.select("doc_id", "text", "lang"), learn, p)
    if not sample:
        return Model((), np.zeros((p.buckets + 1, 0), np.float32), np.zeros(0, np.float32), np.full(CLASSES, -np.inf))
    kept = [s for i, s in enumerate(sample) if i % 5 == 4] or sample
    learned = [s for i, s in enumerate(sample) if i % 5 != 4]
    table, bias = _fit(learned, len(languages), p)
    z, y = _logits(kept, table, bias), np.array([s[0] for s in kept])
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 60))
    # smoothed labels keep the temperature finite when all predictions are right
    near = np.full(z.shape, 0.005 / len(languages))
    near[np.arange(len(y)), y] += 0.995
    loss = [-(near * np.log(_softmax(z / t) + 1e-12)).sum(axis=1).mean() for t in grid]
    t = grid[int(np.argmin(loss))]
    kept += [crop for s in kept for crop in s[4]]
    familiar = _familiarity(learned, len(languages), p.buckets)
    best = _logits(kept, table, bias).argmax(axis=1)
    right = best == np.array([s[0] for s in kept])
    value = _logits(kept, familiar, np.zeros(len(languages)))[np.arange(len(kept)), best]
    length = _length_class(np.array([s[3] for s in kept]))
    thresholds = _thresholds(value[right], length[right], p.risk)
    # halfway to what an even spread of subwords, that is noise, would have
    noise = familiar.mean(axis=0).max()
    thresholds = np.where(thresholds > noise, (thresholds + noise) / 2, thresholds)
    full = np.zeros((p.buckets + 1, 2 * len(languages)), np.float32)
    full[:-1] = np.concatenate([table / t, familiar], axis=1)
    return Model(languages, full, (bias / t).astype(np.float32), thresholds)


def _lettered(data: np.ndarray, at: np.ndarray, row: int, texts: pa.Array) -> np.ndarray:
    """Texts with a letter: an ASCII one is seen in the bytes, others are looked for."""
    folded = _FOLD[data]
    ascii_letters = np.concatenate([[0], np.cumsum((folded > 96) & (folded < 123))])
    found = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    for k in np.flatnonzero(~found & (at[1:] > at[:-1])):
        found[k] = any(c.isalpha() for c in texts[int(row + k)].as_py())
    return found


def score(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language of each text (-1: none), its calibrated probability, and whether it is accepted."""
    n = len(model.languages)
    best, sure, accepted = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for row, data, at in pieces(texts, SCORED):
        if not n or not len(data):
            continue
        m = len(at) - 1
        total, seen = np.zeros((m, 2 * n)), np.zeros(m)
        edges = np.flatnonzero(at[1:] > at[:-1])
        for grams in subwords(data, at, len(model.table) - 1):
            total[edges] += np.add.reduceat(model.table[grams], at[edges], dtype=np.float32)
            seen[edges] += np.add.reduceat((grams < len(model.table) - 1).astype(np.int64), at[edges])
        mean = total / np.maximum(seen, 1)[:, None]
        prob = _softmax(mean[:, :n] + model.bias)
        ok = _lettered(data, at, row, texts)
        likely = prob.argmax(axis=1)
        familiar = mean[np.arange(m), n + likely]
        best[row : row + m] = np.where(ok, likely, -1)
        sure[row : row + m] = np.where(ok, prob.max(axis=1), 0)
        # the table is kept in less precision than the thresholds
        accepted[row : row + m] = ok & (familiar >= model.thresholds[_length_class(seen)] - 1e-4)
    return best, sure, accepted


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``; only the text is looked at.

    The model has a fixed size (buckets times languages) and goes out as a broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches):
        m = Model(*sent.value)
        names = np.array([*m.languages, UND], dtype=object)
        for batch in batches:
            best, sure, accepted = score(batch.column(1), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names[best], pa.string()),
                    pa.array(sure, pa.float64()),
                    pa.array(~accepted),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    chosen = docs.select("doc_id", "text")
    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of ``docs`` whose language is accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts, Model(*sent.value))[2])

    return docs.filter(accepted(F.col("text")))
