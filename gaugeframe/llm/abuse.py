"""Problem 3: how abusive, hateful or sexual a text is, as an expected severity, and the rates of sources.

Method: cumulative-link ordinal regression on sparse text features. The severity grade of a rated sample is 0 (no rater
found it toxic), 1 (raters disagree) or 2 (all did). For thresholds t1 < t2 with shared weights w,
P(grade > k) = sigmoid(w x - t_k); the score is the expected grade, between 0 and 2. x holds hashed words, word pairs
and pairs with a gap in the window of ten words that scores highest: abuse often is one sentence of a long text, so the
window is chosen anew while the weights are learned.

Words are taken without disguise: digits and signs that stand for letters, spelled-out words, repeated letters; then
stars, swapped and dropped letters, if that leads to a word of weight (the *lexicon*) and the word is not common itself.

The fit runs on the driver over the labelled rows, at most ``MOST`` of them, chosen by hash if there are more, and over
as many unlabelled rows at most, which count as weak examples of grade 0: they keep words that are harmless in the
corpus from getting weight by chance. Words count as common by all rows. Scoring is one pass over all rows with a model
of fixed size.

Cases: null, empty and blank texts score 0; raters' nulls and repeated ratings don't count; without both toxic and other
ratings all scores are 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import sketches
from gaugeframe.llm.shingles import U, mix, slices

MOST = 20_000  # labelled rows in a fit, and unlabelled ones
BINS = 1 << 18
WINDOW = 10
COMMON = 1 / 5_000  # a word in so many texts is common
TOKEN = re.compile(r"[\w@$][\w@$*!]*")
SINGLE = re.compile(r"(?<![^\W_])[^\W_][.\-_ \n*][^\W_][.\-_ \n*][^\W_](?![^\W_])")
SPELLED = re.compile(r"(?<![^\W_])([^\W_])(?:([.\-_ \n*])[^\W_])(?:\2[^\W_])+(?![^\W_])")
LEET = str.maketrans("013457@$!", "oieastasi")
REPEATED = re.compile(r"(.)\1+")
VOWELS = re.compile(r"[aeiou]")


def _joined(m: re.Match) -> str:
    s = m.group(0).replace(m.group(2), "")
    return f"{s[0]} {s[1:]}" if len(s) > 3 and s[0] in "aiAI" else s


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    if SINGLE.search(text):  # quicker than to look for whole spelled-out words
        text = SPELLED.sub(_joined, text)
    return TOKEN.findall(text)


def bare(token: str) -> str:
    """Lower case, letters for look-alike digits and signs, letters not repeated in words of five or more."""
    w = token.lower().strip("*!_")
    if not w.isalpha() and any(c.isalpha() for c in w):
        w = w.translate(LEET)
    return REPEATED.sub(r"\1", w) if len(w) > 4 else re.sub(r"(.)\1{2,}", r"\1", w)


class Lexicon:
    """Words of weight and what they turn into with a letter dropped, swapped or starred, or without vowels."""

    def __init__(self, words: list[str]) -> None:
        self.words = set(words)
        self.short: dict[str, str] = {}
        self.bones: dict[str, str] = {}
        for w in sorted(words):
            if len(w) > 3:
                for i in range(len(w)):
                    self.short.setdefault(w[:i] + w[i + 1 :], w)
                    if i:  # two letters swapped
                        self.short.setdefault(w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :], w)
            for b in {VOWELS.sub("", w), REPEATED.sub(r"\1", VOWELS.sub("", w))}:
                if len(b) > 2 and b != w:
                    self.bones.setdefault(b, w)

    def find(self, w: str) -> str:
        if w in self.words or len(w) < 3 or w.isdigit():
            return w
        if "*" in w:
            same = re.compile(w.replace("*", "."))
            return next((x for x in sorted(self.words) if len(x) == len(w) and same.fullmatch(x)), self.short.get(w.replace("*", ""), w))
        if w in self.bones:
            return self.bones[w]
        return self.short.get(w, w)


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: tuple[float, float]
    lexicon: list[str]
    common: np.ndarray  # bit set of the hashes of common words


class Hasher(dict):
    """Token -> hash of its undisguised word; remembers what it has seen, up to a million tokens."""

    def __init__(self, model: Model | None) -> None:
        super().__init__()
        self.lexicon = Lexicon(model.lexicon) if model else None
        self.common = model.common if model else None

    def word(self, token: str) -> str:
        w = bare(token)
        if self.lexicon and not self._common(w):
            w = self.lexicon.find(w)
        return w

    def _common(self, w: str) -> bool:
        return w not in self.lexicon.words and bool(sketches.has(self.common, np.array([xxhash.xxh64_intdigest(w)], U))[0])

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(self.word(token))
        return h


def hashed(texts: list[str | None], hasher: Hasher, slice_: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(bins [3, tokens], start of each text's tokens [texts + 1]). The words of few texts are held at once."""
    got = [_hashed(texts[i : i + slice_], hasher) for i in range(0, len(texts), slice_)] or [_hashed([], hasher)]
    sizes = np.concatenate([np.diff(s) for _, s in got])
    return np.concatenate([b for b, _ in got], axis=1), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _hashed(texts: list[str | None], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    every = [tokens(t) for t in texts]
    start = np.r_[0, np.cumsum([len(x) for x in every])].astype(np.int64)
    h = np.fromiter((v for x in every for v in map(hasher.__getitem__, x)), U, int(start[-1]))
    doc = np.repeat(np.arange(len(texts)), np.diff(start))
    out = np.zeros((3, len(h)), np.int32)
    out[0] = (mix(h) % U(BINS - 1)).astype(np.int32) + 1  # bin 0 is for no feature and has no weight
    for gap in (1, 2):
        if len(h) > gap:
            both = (mix(h[:-gap] * U(0x9E3779B97F4A7C15 + 2 * gap) + h[gap:]) % U(BINS - 1)).astype(np.int32) + 1
            out[gap, gap:] = np.where(doc[:-gap] == doc[gap:], both, 0)
    return out, start


def best_windows(bins: np.ndarray, start: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token of the best window, its score) of each text; texts without tokens have score 0."""
    n = np.diff(start)
    total = np.zeros(bins.shape[1] + 1)
    for b in bins:
        total[1:] += w[b]
    np.cumsum(total, out=total)
    end = np.repeat(start[1:], n)
    at = np.arange(len(end))
    s = total[np.minimum(at + WINDOW, end)] - total[at]
    some = n > 0
    score, first = np.zeros(len(n)), start[:-1].copy()
    if some.any():
        score[some] = np.maximum.reduceat(s, start[:-1][some])
        hit = np.flatnonzero(s == np.repeat(score, n))
        doc = np.repeat(np.arange(len(n)), n)[hit]
        d, k = np.unique(doc, return_index=True)
        first[d] = hit[k]
    return first, score


def _window_bins(bins: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[texts, 3 * WINDOW] bins of the window that begins at first; 0 past a text's end."""
    at = first[:, None] + np.arange(WINDOW)
    ok = at < start[1:, None]
    out = bins[:, np.where(ok, at, 0)] if bins.shape[1] else np.zeros((3, *at.shape), np.int32)
    return np.where(ok, out, 0).transpose(1, 0, 2).reshape(len(first), -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(bins: np.ndarray, start: np.ndarray, grade: np.ndarray, sure: np.ndarray, ridge: float = 0.03, rounds: int = 12, steps: int = 25) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights by bin and both thresholds. sure: False for the weak examples, which have as much say as the sure ones of grade 0."""
    toxic = grade > 0
    doc = np.repeat(np.arange(len(grade)), np.diff(start))
    w = np.zeros(BINS)
    p, q = np.zeros(BINS), np.zeros(BINS)
    for b in bins:
        seen = np.unique(doc * BINS + b)
        bin_, of = seen % BINS, seen // BINS
        p += np.bincount(bin_, toxic[of], BINS)
        q += np.bincount(bin_, ~toxic[of], BINS)
    del seen, bin_, of, doc
    ratio = np.log((p + 0.5) / (toxic.sum() + 1)) - np.log((q + 0.5) / ((~toxic).sum() + 1))
    w = np.where(p + q > 0, ratio / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)), 0) * 0.4
    w[0] = 0
    kind = np.where(toxic, 0, np.where(sure, 1, 2))
    share = np.bincount(kind, minlength=3)
    weight = (np.array([0.5, 0.25, 0.25]) / np.maximum(share, 1))[kind] * len(grade)
    t = np.array([1.0, 2.0])
    g2, t2 = np.full(BINS, 1e-3), np.full(2, 1e-3)
    for k in range(rounds):
        x = _window_bins(bins, start, best_windows(bins, start, w)[0])
        if k == 0:
            s = w[x].sum(1)
            t += np.median(s)
        for _ in range(steps):
            s = w[x].sum(1)
            slope = np.zeros(len(s))
            t_slope = np.zeros(2)
            for j in (0, 1):
                # a cumulative link: grade > j or not
                r = (_sigmoid(s - t[j]) - (grade > j)) * weight
                slope += r
                t_slope[j] = -r.sum()
            g = np.bincount(x.ravel(), np.repeat(slope, x.shape[1]), BINS) + ridge * len(s) / 100 * w
            g[0] = 0
            g2 += g * g
            t2 += t_slope * t_slope
            w -= 0.5 * g / np.sqrt(g2)
            t -= 0.5 * t_slope / np.sqrt(t2)
            t[1] = max(t[1], t[0] + 1e-3)
    return w, (float(t[0]), float(t[1]))


def grades(ratings: DataFrame) -> DataFrame:
    """(sample_id, grade): 0 no rating is toxic, 2 all are, 1 otherwise; repeated and null ratings don't count."""
    share = ratings.filter("toxic is not null").select("sample_id", "rater", "toxic", "rated_at").distinct().groupBy("sample_id").agg(F.avg("toxic").alias("share"))
    return share.select("sample_id", F.when(F.col("share") == 0, 0).when(F.col("share") == 1, 2).otherwise(1).alias("grade"))


def common_words(df: DataFrame, text_col: str) -> np.ndarray:
    """Bit set of the words that stand in many of all texts (by a counter sketch, so a few rare ones may slip in)."""

    def words(b: pa.RecordBatch) -> np.ndarray:
        h = Hasher(None)
        out = [set(map(h.__getitem__, tokens(x))) for x in b.column(0).to_pylist()]
        return np.fromiter((x for s in out for x in s), U, sum(map(len, out)))

    texts = df.select(F.col(text_col).cast("string"))
    n = sketches.counts(texts, words)
    found = n > max(2, COMMON * texts.count()) if len(n) else np.zeros(sketches.COUNTERS, bool)
    return np.packbits(found, bitorder="little")


def _about(df: DataFrame, key: str, n: int, salt: int) -> DataFrame:
    """About n rows of df, the same ones each time, by hash of the key; all if there are no more."""
    total = df.count()
    return df if total <= n else df.filter(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * n / total))


def fit(df: DataFrame, ratings: DataFrame, id_col: str = "sample_id", text_col: str = "text", most: int = MOST, common: np.ndarray | None = None) -> Model:
    # about ``most`` rows each, so that the broadcast and what comes to the driver are bounded
    chosen = _about(grades(ratings), "sample_id", most, 1)
    texts = df.select(F.col(id_col).alias("sample_id"), F.col(text_col).cast("string").alias("text"))
    weak = _about(texts, "sample_id", most, 2).withColumn("weak", F.lit(True))
    known = texts.join(F.broadcast(chosen), "sample_id").withColumn("weak", F.lit(False))
    rows = known.unionByName(weak.withColumn("grade", F.lit(0))).filter("text is not null").collect()
    rated = {r.sample_id for r in rows if not r.weak}
    rows = list({(r.sample_id, r.weak): r for r in sorted(rows, key=lambda r: (r.sample_id, r.weak, r.text)) if not (r.weak and r.sample_id in rated)}.values())
    common = common_words(df, text_col) if common is None else common
    return fit_rows([r.text for r in rows], np.array([r.grade for r in rows], np.int64), np.array([not r.weak for r in rows], bool), common)


def fit_rows(texts: list[str], grade: np.ndarray, sure: np.ndarray, common: np.ndarray, heavy: float = 0.6) -> Model:
    if len(set((grade[sure] > 0).tolist())) < 2:
        return Model(np.zeros(BINS, np.float32), (1e3, 1e3), [], common)
    first = Hasher(None)
    w, t = train(*hashed(texts, first), grade, sure)
    # words of weight in several toxic texts; their disguises count as the word from now on
    counts: dict[str, int] = {}
    for x, g in zip(texts, grade):
        if g:
            for word in {bare(k) for k in tokens(x)}:
                counts[word] = counts.get(word, 0) + 1
    words = [x for x, n in counts.items() if n > 1 and len(x) > 2 and x.isalpha() and w[int(mix(np.array([xxhash.xxh64_intdigest(x)], U))[0] % U(BINS - 1)) + 1] > heavy]
    # rarer spellings of a heavier word are no words of their own
    lexicon: list[str] = []
    for x in sorted(words, key=lambda v: (-counts[v], v)):
        if len(x) < 4 or Lexicon(lexicon).find(x) == x:
            lexicon.append(x)
    model = Model(w.astype(np.float32), t, lexicon, common)
    w, t = train(*hashed(texts, Hasher(model)), grade, sure)
    return model._replace(weights=w.astype(np.float32), thresholds=t)


def severity(texts: list[str | None], model: Model, hasher: Hasher) -> np.ndarray:
    bins, start = hashed(texts, hasher)
    s = best_windows(bins, start, model.weights.astype(np.float64))[1]
    out = sum(_sigmoid(s - t) for t in model.thresholds)
    return np.where(np.diff(start) > 0, out, 0.0)


def scores(df: DataFrame, model: Model, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(id, severity double): the expected grade, 0 to 2, of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shared.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity(b.column(1).to_pylist(), shared.value, hasher))], ["id", "severity"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string")).mapInArrow(part, "id bigint, severity double")


def source_rates(df: DataFrame, model: Model, least: float = 1.0) -> DataFrame:
    """(source, records, abusive, rate, mean_severity)."""
    rows = scores(df, model).join(df.select(F.col("sample_id").alias("id"), "source"), "id")
    return rows.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("severity") >= least).alias("abusive"), F.avg("severity").alias("mean_severity")).withColumn("rate", F.col("abusive") / F.col("records"))
