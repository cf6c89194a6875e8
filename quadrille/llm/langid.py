"""Language identification in two steps: a linear classifier chooses the language family, then one-versus-one linear
support vector machines vote between the languages of that family.

A text's features are the relative frequencies of its hashed byte 3- and 4-grams (lower case, all but letters blank).
As every classifier is linear in them, a text's margin is a mean of the weights that its n-grams select, worked out
over whole Arrow buffers. Training takes a bounded sample of labelled rows to the driver, as counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_column, bounded, give_back, runs, text_buffers, thrifty, unit_hash

#: Families of languages by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr uz",
    "semitic": "am ar he mt",
    "sinitic": "yue zh",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv ms tl",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

#: Buckets of n-grams; labelled rows a language at most and rows in all at most; bytes worked on at a time.
BUCKETS = 1 << 13
PER_LANG, SAMPLE = 400, 4000
CHUNK = 1 << 20
UNKNOWN = "und"
#: Share of a language's n-grams taken to be spread evenly over all buckets: none is rarer than that by more.
EVEN = 0.01

#: Blank for ASCII other than letters.
_MAP = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def _letters(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- and 4-grams that begin at each byte but the last three; where they begin at a letter or in
    front of one."""
    x = _MAP[data].astype(np.uint32)
    three = x[:-3] * np.uint32(0x9E3779B1) + x[1:-2] * np.uint32(0x85EBCA77) + x[2:-1] * np.uint32(0xC2B2AE3D)
    four = three * np.uint32(0x27D4EB2F) + x[3:] * np.uint32(0x165667B1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 2)
    half = BUCKETS // 2
    return np.stack(((three ^ three >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift, half + ((four ^ four >> np.uint32(15)) * np.uint32(0x297A2D39) >> shift))), (
        x[:-3] != 32
    ) | (x[1:-2] != 32)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row's place in bytes, bytes) with three blanks around each text, by chunks; a text longer than
    a chunk comes in several, overlapping ones."""
    at, data = text_buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    for i, j in runs(at, CHUNK):
        if j - i == 1:
            whole = np.full(int(at[j] - at[i]) + 4, 32, np.uint8)
            whole[1:-3] = data[at[i] : at[j]]
            for k in range(0, len(whole) - 3, CHUNK):
                piece = whole[k : k + CHUNK + 3]
                yield i, 1, np.array([0, len(piece) - 3]), piece
        else:
            lengths = np.diff(at[i : j + 1])
            starts = np.concatenate(([0], np.cumsum(lengths + 4)))
            piece = np.full(int(starts[-1]) + 3, 32, np.uint8)
            piece[np.arange(int(lengths.sum())) + np.repeat(starts[:-1] + 1 - (at[i:j] - at[i]), lengths)] = data[at[i] : at[j]]
            yield i, j - i, starts, piece


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each text and each column of weights (buckets x classifiers): the mean weight of its n-grams; 0 without."""
    total, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    columns = [np.ascontiguousarray(weights[:, c]) for c in range(weights.shape[1])]
    for i, rows, starts, piece in _pieces(texts):
        grams, on = _grams(piece)
        at = starts[:-1]
        count[i : i + rows] += 2 * np.add.reduceat(on, at, dtype=np.int64)
        for c, w in enumerate(columns):
            total[i : i + rows, c] += np.add.reduceat((w[grams[0]] + w[grams[1]]) * on, at)
    return total / np.maximum(count, 1)[:, None]


def histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their counts."""
    counts = np.zeros(BUCKETS, np.int64)
    for _, _, starts, piece in _pieces(pa.array([text], pa.large_string())):
        grams, on = _grams(piece)
        n = int(starts[-1])
        for g in grams:
            counts += np.bincount(g[:n][on[:n]], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 40, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge loss, classes weighed evenly), by dual
    coordinate descent on the Gram matrix. y: 1 or -1."""
    gram = (x @ x.T).astype(np.float64) + 1.0
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = gram.diagonal() + 0.5 / cost
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            step = max(-alpha[i], (1 - y[i] * f[i] - alpha[i] * 0.5 / cost[i]) / diagonal[i])
            if abs(step) > 1e-9:
                alpha[i] += step
                f += step * y[i] * gram[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return ((alpha * y).astype(x.dtype) @ x).astype(np.float64), float((alpha * y).sum())


class LanguageModel:
    """Classifiers, as columns of one weight matrix: first one for each family against the rest (a single one for two),
    then one for each pair of languages of a family."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, families: list[str], pairs: list[tuple[str, str]], usual: np.ndarray):
        self.langs, self.weights, self.bias, self.families, self.pairs, self.usual = langs, weights, bias, families, pairs, usual
        self.members = {f: [x for x in langs if _FAMILY.get(x, x) == f] for f in families}

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 0) -> LanguageModel:
        """rows: (language, buckets, counts)."""
        langs = sorted({r[0] for r in rows})
        families = sorted({_FAMILY.get(x, x) for x in langs})
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (_, at, n) in enumerate(rows):
            x[i, at] = n / max(1, n.sum())
        mean = x.mean(0, dtype=np.float64) if len(rows) else np.zeros(BUCKETS)
        x -= mean.astype(np.float32)
        scale = 1 / (np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float64) / max(1, len(rows))) + 1e-4) if len(rows) else np.ones(BUCKETS)
        x *= (scale / np.sqrt(BUCKETS)).astype(np.float32)
        own = np.array([r[0] for r in rows])
        family = np.array([_FAMILY.get(r[0], r[0]) for r in rows])
        weights, bias = [], []

        def add(some: np.ndarray, y: np.ndarray) -> None:
            w, b = svm(x if len(some) == len(x) else x[some], y, seed=seed)
            w = w * scale / np.sqrt(BUCKETS)
            weights.append(w)
            bias.append(b - w @ mean)

        for f in families[: 1 if len(families) == 2 else None] if len(families) > 1 else []:
            add(np.arange(len(rows)), np.where(family == f, 1.0, -1.0))
        pairs = [p for f in families for p in combinations([x for x in langs if _FAMILY.get(x, x) == f], 2)]
        for a, b in pairs:
            some = np.flatnonzero((own == a) | (own == b))
            add(some, np.where(own[some] == a, 1.0, -1.0))
        # how many times as often as by even chance a language has an n-gram, as a logarithm; 3- and 4-grams apart
        usual, half = np.zeros((BUCKETS, len(langs))), BUCKETS // 2
        for lang, at, n in rows:
            usual[at, langs.index(lang)] += n
        for part in (usual[:half], usual[half:]):
            part[:] = np.log((1 - EVEN) * (part + 0.5) / (part.sum(0) + 0.5 * half) * half + EVEN)
        return cls(langs, np.array(weights).T.reshape(BUCKETS, -1), np.array(bias), families, pairs, usual)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each text; UNKNOWN and 0 for null and for texts without a letter, or if no language was
        learned."""
        if not self.langs:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        return self._vote(texts, margins(texts, self.weights) + self.bias)[:2]

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, margin, likeness) of each text. margin: the least by which the family, then the language, won, where
        1 is what training asks for, whatever the number of languages. likeness: the mean over n-grams of how many
        times as often as by even chance the language that suits best has them, as a logarithm. UNKNOWN, 0 and 0 where
        predict() answers UNKNOWN."""
        if not self.langs:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
        both = margins(texts, np.hstack((self.weights, self.usual)))
        n = len(self.bias)
        lang, _, margin = self._vote(texts, both[:, :n] + self.bias)
        return lang, margin, np.where(lang == UNKNOWN, 0.0, both[:, n:].max(1))

    def _vote(self, texts: pa.Array, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, margin) of texts with the classifiers' margins m."""
        known = np.asarray(_letters(texts).to_pylist(), bool)
        sure = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        nf = len(self.families)
        if nf == 1:
            p_family = np.ones((len(texts), 1))
        elif nf == 2:
            p_family = np.stack((sure[:, 0], 1 - sure[:, 0]), 1)
        else:
            p_family = sure[:, :nf] / np.maximum(sure[:, :nf].sum(1, keepdims=True), 1e-12)
        first = {1: 0, 2: 1}.get(nf, nf)
        family = p_family.argmax(1)
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        margin = np.full(len(texts), np.inf)
        if nf == 2:
            margin = np.abs(m[:, 0])
        elif nf > 2:
            two = np.sort(m[:, :nf], 1)[:, -2:]
            margin = (two[:, 1] - two[:, 0]) / 2
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            members = self.members[name]
            votes, faith = np.zeros((len(rows), len(members))), np.ones((len(rows), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = sure[rows, first + k]
                    for who, q in ((members.index(a), p), (members.index(b), 1 - p)):
                        votes[:, who] += q > 0.5
                        faith[:, who] *= q
            best = (votes + faith / 2).argmax(1)
            for k, (a, b) in enumerate(self.pairs):
                for who, sign in ((a, 1), (b, -1)):
                    if who in members:
                        won = rows[best == members.index(who)]
                        margin[won] = np.minimum(margin[won], sign * m[won, first + k])
            lang[rows] = np.array(members, object)[best]
            score[rows] = p_family[rows, f] * faith[np.arange(len(rows)), best] ** (1 / max(1, len(members) - 1))
        lang[~known], score[~known], margin[~known] = UNKNOWN, 0.0, 0.0
        return lang, np.clip(score, 0.0, 1.0), margin


def fit_languages(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_cols: tuple[str, ...] = ("doc_id",), per_lang: int = PER_LANG, sample: int = SAMPLE, seed: int = 0
) -> LanguageModel:
    """Learns from rows of df with a language and a letter: at most `per_lang` whole texts a language and `sample` in
    all, those of least hash of text and key_cols (which serve for nothing else); equal rows count once. The cut is made where the
    rows are, so `sample` lists of BUCKETS counts at most reach the driver, however rows and keys repeat. More than half as many
    languages as `sample` are an error; rows without any such label give a model that answers UNKNOWN."""
    bounded(df.sparkSession)
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(key_cols)])
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", unit_hash(seed, F.col("text"), *[F.col(f"k{i}") for i in range(len(key_cols))]).alias("u"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("u").alias("n")).limit(sample // 2 + 1).collect()}
    if not counts:
        return LanguageModel.fit([])
    if len(counts) > sample // 2:
        raise ValueError(f"more than {sample // 2} languages")
    each = max(2, min(per_lang, sample // len(counts)))
    limit = F.element_at(F.create_map(*[F.lit(y) for k, n in counts.items() for y in (k, 1.5 * each / max(1, n) + 20 / max(1, n))]), F.col("lang"))
    some = rows.where((F.col("u") < limit) & F.col("text").rlike(r"\p{L}")).groupBy("lang", "u").agg(F.first("text").alias("text"))
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("nth") <= each)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [histogram(x.as_py()) for x in batch.column("text")]
            lists = [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.record_batch({"u": batch.column("u"), "lang": batch.column("lang"), "at": lists[0], "n": lists[1]})

    got = some.select("u", "lang", "text").mapInArrow(thrifty(count), "u double, lang string, at array<int>, n array<int>").toArrow().sort_by([("lang", "ascending"), ("u", "ascending")])
    arrays = [got.column(c).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("at", "n")]
    lists = [[x.values.to_numpy() for x in a] for a in arrays]
    model = LanguageModel.fit(list(zip(got.column("lang").to_pylist(), *lists, strict=True)), seed)
    del got, arrays, lists
    give_back()
    return model


def predicted(model: LanguageModel, text: Column) -> Column:
    """struct(lang, score) of a text: null and texts without a letter are UNKNOWN with score 0. Texts are read whole;
    no other column counts."""

    def predict(texts: pa.Array) -> pa.Array:
        lang, score = model.predict(texts)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return arrow_column(predict, "lang string, score double")(text.cast("string"))


def judged(model: LanguageModel, text: Column) -> Column:
    """struct(lang, margin, likeness, letters) of a text: judge()'s three, and the share of letters (of any byte beyond
    ASCII, too) in its bytes other than white space. Stands as not deterministic, as a filter on its fields would
    otherwise have Spark work it out twice, by twice the workers."""

    def share(x: pa.Scalar) -> float:
        data = np.frombuffer(x.as_py().encode() if x.is_valid else b"", np.uint8)
        return float(np.count_nonzero(_MAP[data] != 32) / max(1, np.count_nonzero(data > 32)))

    def judge(texts: pa.Array) -> pa.Array:
        found = [pa.array(x) for x in model.judge(texts)] + [pa.array(map(share, texts), pa.float64())]
        return pa.StructArray.from_arrays(found, ["lang", "margin", "likeness", "letters"])

    return arrow_column(judge, "lang string, margin double, likeness double, letters double").asNondeterministic()(text.cast("string"))
