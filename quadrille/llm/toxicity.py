"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (with its edges) and itself, so an unseen misspelling shares most of
its vectors with words that training saw. A span's vector is the mean of its bag's embeddings, and a linear softmax
turns it into the probability of the toxic class; embeddings and softmax are trained jointly, by Adam in numpy.

Labels belong to whole documents, while what makes one toxic may be a word in thousands. So training takes of each
document the span that scores highest (of a clean one: its worst), first by how much more often its n-grams occur in
toxic documents than in others, then, round after round, by the model; and a document's score is that of its highest
span, all spans of the whole text being scored. A word that repeats within a span's length counts once and leaves its
place empty. Since the softmax is linear, a span's logit is a mean of one number per bucket, which makes scoring a few
passes over Arrow buffers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, bounded, give_back, runs, spread, text_buffers, unit_hash

#: Buckets of n-grams, their lengths in bytes, components of an embedding.
BUCKETS, GRAMS, DIM = 1 << 16, (3, 4, 5, 6), 8
#: Words of a span, and from a span to the next.
SPAN, STEP = 12, 6
#: Spans of a document that training takes at most.
SPANS = 6
#: Toxic documents to learn from at most, twice as many others, and bytes of all their texts at most.
PER_CLASS, TEXT_BYTES = 1200, 24 << 20
CHUNK = 1 << 19

#: What weights shrink by in a step of rate one.
DECAY = 0.1

_MAP = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up, down = _powers(_P, CHUNK), _powers(_INVERSE, CHUNK)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = _powers(_P, n), _powers(_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes whose first and last are blank."""
    on = data != 32
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    return edge[::2], edge[1::2]


def bag(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Yields (buckets, word): for each word its own bucket, then those of its n-grams, length by length. n-grams may hold
    the blank on either side of the word, and no other."""
    up, down = _Powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    yield (total[ends] - total[starts]) * down[starts], np.arange(len(starts))
    length = ends - starts + 2
    for n in GRAMS:
        m = np.maximum(0, length - n + 1)
        here = spread(starts - 1, m)
        yield (total[here + n] - total[here]) * down[here], m


def _first(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which words did not occur in the SPAN words before them, in the same row."""
    order = np.lexsort((np.arange(len(row)), hashes))
    again = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1]) & (np.diff(order) < SPAN)
    out = np.ones(len(row), bool)
    out[order[1:][again]] = False
    return out


def _pieces(texts: pa.Array):
    """(first row, rows, for each word its row, starts, ends, bytes) of lower-case texts, by chunks of whole rows; a
    longer row is cut between words, its parts overlapping by a span of words."""
    at, data = text_buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    for i, j in runs(at, CHUNK):
        if j - i == 1 and at[j] - at[i] > CHUNK:
            whole = np.full(int(at[j] - at[i]) + 2, 32, np.uint8)
            whole[1:-1] = _MAP[data[at[i] : at[j]]]
            starts, ends = words_of(whole)
            k = 0
            while k < len(starts):
                m = max(k + 2 * SPAN, int(np.searchsorted(ends, starts[k] + CHUNK, "right")))
                s, e = starts[k:m], ends[k:m]
                low = s[0] - 1
                yield i, np.zeros(len(s), np.int64), s - low, e - low, whole[low : e[-1] + 1]
                k = m if m >= len(starts) else m - SPAN
        else:
            n = np.diff(at[i : j + 1])
            place = np.cumsum(n + 1) - n
            piece = np.full(int(n.sum() + len(n)) + 1, 32, np.uint8)
            piece[spread(place, n)] = _MAP[data[at[i] : at[j]]]
            starts, ends = words_of(piece)
            yield i, np.searchsorted(place, starts, "right") - 1, starts, ends, piece


def _word_sums(weights: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the sum of its bag's weights (0 for a repeated one), and the size of the bag."""
    parts = bag(data, starts, ends)
    hashes, _ = next(parts)
    totals, counts = weights[_bucket(hashes)], np.ones(len(starts), np.int64)
    for grams, m in parts:
        run = np.concatenate(([0.0], np.cumsum(weights[_bucket(grams)])))
        after = np.cumsum(m)
        totals += run[after] - run[after - m]
        counts += m
    return totals * _first(hashes, row), counts


def _spans(row: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end, mean) of the spans: each STEP words of a row a span of SPAN words or what is left."""
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(row)])))
    n = np.maximum(1, -(-(size - SPAN) // STEP) + 1)
    begin = np.repeat(first, n) + STEP * spread(np.zeros(len(n), np.int64), n)
    end = np.minimum(begin + SPAN, np.repeat(first + size, n))
    a, b = np.concatenate(([0.0], np.cumsum(sums))), np.concatenate(([0], np.cumsum(counts)))
    return row[begin], begin, end, (a[end] - a[begin]) / np.maximum(1, b[end] - b[begin])


class ToxicityModel:
    """weights: the logit of the toxic class that each bucket adds, already projected by the softmax; bias; scale and
    shift turn the highest span's logit into a document's."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0, prior: float = 0.0):
        self.weights, self.bias, self.scale, self.shift, self.prior = weights, bias, scale, shift, prior

    def worst(self, texts: pa.Array, most: int = 1) -> tuple[np.ndarray, list[list[tuple[float, np.ndarray]]]]:
        """For each text its highest span's logit (-inf without a word), and (logit, bytes) of its `most` highest spans."""
        spans: list[list] = [[] for _ in range(len(texts))]
        for i, row, starts, ends, data in _pieces(texts):
            if len(starts):
                r, a, b, mean = _spans(row, *_word_sums(self.weights, row, starts, ends, data))
                order = np.lexsort((a, -mean, r))
                first = np.flatnonzero(np.concatenate(([True], r[order][1:] != r[order][:-1])))
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))
                for k in order[rank < most]:
                    spans[i + r[k]].append((mean[k] + self.bias, data[starts[a[k]] - 1 : ends[b[k] - 1] + 1].copy()))
        spans = [sorted(x, key=lambda s: -s[0])[:most] for x in spans]
        return np.array([x[0][0] if x else -np.inf for x in spans]), spans

    def score(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for each text: a text without a word has the share of toxic documents seen in training."""
        best = np.full(len(texts), -np.inf)
        for i, row, starts, ends, data in _pieces(texts):
            if len(starts):
                r, _, _, mean = _spans(row, *_word_sums(self.weights, row, starts, ends, data))
                np.maximum.at(best, i + r, mean + self.bias)
        logit = np.where(np.isfinite(best), self.scale * np.where(np.isfinite(best), best, 0) + self.shift, self.prior)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _counts(spans: list[np.ndarray], most: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pointers, buckets, shares) of each span's bag, worked out for `most` spans at a time; the shares add up to one, or
    less if words repeat."""
    sizes, buckets, shares = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for i in range(0, len(spans), most):
        some = spans[i : i + most]
        data, place = np.concatenate(some), np.cumsum([0, *map(len, some)])
        starts, ends = words_of(data)
        row = np.searchsorted(place, starts, "right") - 1
        parts = bag(data, starts, ends)
        hashes, _ = next(parts)
        keep = _first(hashes, row)
        keys, total = [row[keep] * BUCKETS + _bucket(hashes)[keep]], np.bincount(row, minlength=len(some))
        for grams, m in parts:
            keys.append((np.repeat(row, m) * BUCKETS + _bucket(grams))[np.repeat(keep, m)])
            total += np.bincount(row, m, len(some)).astype(np.int64)
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        own = key // BUCKETS
        sizes.append(np.bincount(own, minlength=len(some)))
        buckets.append((key % BUCKETS).astype(np.int32))
        shares.append((n / np.maximum(1, total)[own]).astype(np.float32))
    return np.cumsum(np.concatenate(sizes)), np.concatenate(buckets), np.concatenate(shares)


def _contrast(texts: list[str], y: np.ndarray) -> np.ndarray:
    """For each bucket, by how many standard errors more of the toxic documents than of the others have it."""
    has = np.zeros((2, BUCKETS))
    for text, c in zip(texts, y, strict=True):
        data = np.concatenate(([np.uint8(32)], _MAP[np.frombuffer(text.lower().encode(), np.uint8)], [np.uint8(32)]))
        starts, ends = words_of(data)
        if len(starts):
            has[c][np.unique(np.concatenate([_bucket(h) for h, _ in bag(data, starts, ends)]))] += 1
    n = np.maximum(1, np.bincount(y, minlength=2))
    p = has.sum(0) / n.sum()
    return (has[1] / n[1] - has[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-6)


def train(
    bags: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weigh: np.ndarray, state: dict | None, epochs: int, seed: int, rate: float = 0.05
) -> dict:
    """Embeddings e and softmax w, b, trained jointly by Adam on the weighed cross-entropy."""
    rng = np.random.default_rng(seed)
    if state is None:
        state = {"e": rng.normal(0, 0.1, (BUCKETS, DIM)), "w": rng.normal(0, 0.1, (DIM, 2)), "b": np.zeros(2)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in state.items()}
    pointer, at, share = bags
    t = 0
    for _ in range(epochs):
        for docs in np.array_split(rng.permutation(len(y)), max(1, len(y) // 512)):
            length = pointer[docs + 1] - pointer[docs]
            pick = spread(pointer[docs], length)
            idx, s = at[pick], share[pick]
            own = np.repeat(np.arange(len(docs)), length)
            rows = state["e"][idx]
            h = np.stack([np.bincount(own, rows[:, d] * s, len(docs)) for d in range(DIM)], 1)
            z = h @ state["w"] + state["b"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            p *= weigh[docs][:, None] / max(1e-9, weigh[docs].sum())
            back = p @ state["w"].T
            grads = {"e": np.stack([np.bincount(idx, back[own, d] * s, BUCKETS) for d in range(DIM)], 1), "w": h.T @ p, "b": p.sum(0)}
            t += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                state[k] *= 1 - rate * DECAY
                state[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return state


def fit(texts: list[str], y: np.ndarray, share: float, rounds: int = 3, epochs: int = 12, seed: int = 0) -> ToxicityModel:
    """texts and their classes (0 or 1); share: that of class 1 in the corpus."""
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(y) or y.min() == y.max():
        fixed = prior if not len(y) else (4.0 if y.min() else -4.0)
        return ToxicityModel(np.zeros(BUCKETS), 0.0, 0.0, fixed, fixed)
    array = pa.array(texts, pa.large_string())
    model, state = ToxicityModel(_contrast(texts, y), 0.0), None
    for r in range(rounds):
        # of a toxic document also its next spans, if they score nearly as high
        chosen = [(c, data) for c, found in zip(y, model.worst(array, SPANS)[1], strict=True) for v, data in found if not c or v >= found[0][0] - abs(found[0][0]) / 2]
        own = np.array([c for c, _ in chosen], np.int64)
        weigh = np.where(own == 1, 0.5 / max(1, (own == 1).sum()), 0.5 / max(1, (own == 0).sum())) * len(own)
        state = train(_counts([data for _, data in chosen]), own, weigh, state, epochs, seed + r)
        model = ToxicityModel(state["e"] @ (state["w"][:, 1] - state["w"][:, 0]), float(state["b"][1] - state["b"][0]), prior=prior)
    best, _ = model.worst(array)
    seen = np.isfinite(best)
    model.scale, model.shift = _logistic(best[seen], y[seen], np.where(y[seen] == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighed logistic regression on one number, by Newton's method with a light ridge."""
    weigh = weigh / weigh.sum()
    centre, spread_ = float(x.mean()), float(x.std()) or 1.0
    z = np.stack(((x - centre) / spread_, np.ones(len(x))), 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weigh * (p - y)) + 1e-3 * beta * (1, 0)
        hess = (z * (weigh * p * (1 - p))[:, None]).T @ z + np.diag((1e-3, 1e-9))
        step = np.linalg.solve(hess, grad)
        beta = beta - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-6:
            break
    slope = max(1e-6, beta[0]) / spread_
    return slope, float(beta[1] - slope * centre)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
    text_bytes: int = TEXT_BYTES,
    seed: int = 0,
) -> ToxicityModel:
    """Learns from documents whose id is in labels with 0 or 1: at most `per_class` toxic and twice as many other whole
    texts, those of least hash of the id. All of them have at most `text_bytes` bytes, and none more than an eighth of that: longer ones
    teach nothing (they are scored like any other), and one that no longer fits makes room for the next. An id with both labels counts as
    toxic; of an id with several texts the one of least hash counts; null ids, texts and other labels teach nothing; without any
    label every text has the same score.

    Which texts these are is found from hashes and sizes, a row for each of a bounded number of labelled ids; then those texts
    alone reach the driver, however often ids and texts repeat."""
    bounded(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not n:
        return fit([], np.zeros(0, np.int64), 0.5)
    u = unit_hash(seed, F.col("id"))
    limit = F.element_at(F.create_map(*[F.lit(x) for y, c in n.items() for x in (y, 1.3 * per_class * (2 - y) / c + 20 / c)]), F.col("y"))
    # about 1.3 * 3 * per_class + 40 rows, whatever the tables
    some = marks.withColumn("u", u).where(F.col("u") < limit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = texts.where(F.octet_length("text") <= text_bytes // 8).withColumn("h", F.xxhash64("text"))
    found = texts.join(F.broadcast(some), "id").groupBy("id", "y", "u").agg(F.min(F.struct("h", F.octet_length("text").alias("b"))).alias("t"))
    rows = found.select("id", "y", "u", "t.h", "t.b").toArrow()
    order = np.lexsort((rows.column("h").to_numpy(), rows.column("u").to_numpy()))
    y, size = rows.column("y").to_numpy(), rows.column("b").to_numpy()
    taken, used, chosen = {0: 0, 1: 0}, 0, []
    for r in order.tolist():
        if taken[y[r]] < per_class * (2 - y[r]) and used + size[r] <= text_bytes:
            taken[y[r]] += 1
            used += size[r]
            chosen.append(r)
    picked = docs.sparkSession.createDataFrame(rows.take(pa.array(chosen, pa.int64())).select(["id", "h"]).append_column("nth", pa.array(range(len(chosen)), pa.int32())))
    got = texts.join(F.broadcast(picked), ["id", "h"]).groupBy("nth").agg(F.first("text").alias("text")).toArrow().sort_by("nth")
    at = got.column("nth").to_numpy()
    model = fit(got.column("text").to_pylist(), y[np.array(chosen, np.int64)][at].astype(np.int64), n.get(1, 0) / sum(n.values()), seed=seed)
    del got, rows
    give_back()
    return model


def toxicity(model: ToxicityModel, text: Column) -> Column:
    """The score of a text, 0 to 1, from all of it and nothing else; null is an empty text, which has the share of toxic
    documents that training saw as its score."""

    return arrow_column(lambda texts: pa.array(model.score(texts)), "double")(text.cast("string"))
