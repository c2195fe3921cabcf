"""Toxicity of deobfuscated text.

A suspicious stretch is a lattice: digits or signs among letters, letters repeated three times,
single characters spaced out (with one last fragment of up to four letters, "s t u pid"), and letter
groups joined by separators that together make a telling word ("stu-pid"). Each character may stand
for itself or for letters it imitates, repetitions and separators may be dropped, and a separator may
be a word's end. Viterbi finds the likeliest letters under a character trigram model of the corpus.
A logistic model over the words of the plain and the restored text, and over the beginnings that
several words share, gives the score. Left alone, since ordinary text is full of them: two fragments
of several letters with a space between ("stu pid") and numbers without a letter ("455").
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, kept, map_arrow, materialise, texts, with_columns
from .labelled import fitting_sample

# Letters that a sign imitates.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "*": "aeiou", "#": "aeiouh", "%": "aeiou",
}
# Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans("аеорсухіјѕԁαορντικ", "aeopcyxijsdaopvtik")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WIDE = re.compile("[！-～Ͱ-ԯ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SIGN = "0-9@$!|+€£¢(*#%"
_AMONG = re.compile(rf"[^\W\d_][{_SIGN}]|[{_SIGN}][^\W\d_]")
_TAIL = re.compile(r"[.,;:?'\")\]}>-]+$|([!*#$%&@])\1+$|!+$")
_HEAD = re.compile(r"^[.,;:?'\"(\[{<-]+")
_UNIT = rf"(?:[^\W\d_]|[{_SIGN}])"
#: Three or more single characters, each followed by separators and not by a letter.
_SPACED = re.compile(rf"(?<![^\W\d_])({_UNIT}(?:[ \t\n._\-*/,~]{{1,3}}{_UNIT}(?![^\W\d_])){{2,}})([ \t\n._\-*/,~]{{1,3}}[^\W\d_]{{2,4}}(?![^\W\d_]))?")
_SEPARATORS = " \t\n._-*/,~'\"&^"
_JOINED = re.compile(r"[^\W\d_][._\-*/,~'\"&^]{1,3}[^\W\d_]")
#: Lengths of the word beginnings that count as features; a word is longer than its beginning.
STEMS = (4, 5, 6)
#: What longer chunks hold is worked out anew each time, so that a cache is bounded in bytes.
LONGEST = 64
SAID, IMITATED, DROPPED_REPEAT, DROPPED_SIGN, WORD_END = 0.0, -0.3, -3.0, -9.0, -2.0


@dataclass
class CharModel:
    """Interpolated trigrams over letters; a space marks both ends of a word."""

    one: dict[str, int]
    two: dict[str, int]
    three: dict[str, int]
    total: int

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def logp(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        out = self.memo.get(key)
        if out is None:
            if len(self.memo) >= 500_000:
                self.memo.clear()
            three = self.three.get(key, 0) / max(1, self.two.get(a + b, 0))
            two = self.two.get(b + c, 0) / max(1, self.one.get(b, 0))
            out = self.memo[key] = math.log(0.75 * three + 0.2 * two + 0.0499 * self.one.get(c, 0) / max(1, self.total) + 1e-4)
        return out


def trigrams(words: dict[str, int]) -> Counter:
    """How often each three letters follow one another, with two spaces before a word and one after it."""
    three = Counter()
    for word, n in words.items():
        w = f"  {word} "
        for i in range(2, len(w)):
            three[w[i - 2 : i + 1]] += n
    return three


def char_model(three: dict[str, int]) -> CharModel:
    one, two = Counter(), Counter()
    for key, n in three.items():
        one[key[2]] += n
        two[key[1:]] += n
        if key[:2] == "  ":
            two["  "] += n
    return CharModel(dict(one), dict(two), dict(three), sum(one.values()))


def corpus_trigrams(docs: DataFrame, held: int = 200_000) -> dict[str, int]:
    """Trigrams of the words of all documents, a word once a document: summed in each task, then by trigram.

    A task holds at most about `held` distinct words at a time; only distinct trigrams reach the driver.
    """

    def run(batches):
        words, three = Counter(), Counter()
        for batch in batches:
            for s in texts(batch):
                words.update(set(_LETTERS.findall(plain(s or ""))))
                if len(words) >= held:
                    three.update(trigrams(words))
                    words.clear()
        three.update(trigrams(words))
        yield pa.RecordBatch.from_arrays([pa.array(three.keys(), pa.string()), pa.array(three.values(), pa.int64())], names=["gram", "n"])

    counts = docs.select("text").mapInArrow(run, T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())]))
    got = counts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return dict(sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)))


def restore(stretch: str, model: CharModel) -> list[str]:
    """The likeliest words that the stretch stands for."""
    s = stretch.lower()
    # state: the last two letters -> (score, letters so far)
    states: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    for i, ch in enumerate(s):
        options: list[tuple[str, float]] = []
        repeat = i > 0 and s[i - 1] == ch
        if ch.isalpha():
            options.append((ch, SAID))
            if repeat:
                options.append(("", DROPPED_REPEAT if not (i > 1 and s[i - 2] == ch) else 0.0))
        elif ch in _SEPARATORS and ch not in LEET:
            options += [("", SAID), (" ", WORD_END)]
        else:
            options += [(c, IMITATED) for c in LEET.get(ch, "")]
            options.append(("", SAID if repeat else DROPPED_SIGN))
            if ch in _SEPARATORS:
                options.append(("", SAID))
        new: dict[str, tuple[float, tuple]] = {}
        for last, (score, out) in states.items():
            for c, cost in options:
                if c == " " and last[1] == " ":
                    continue
                if c:
                    total, key, more = score + cost + model.logp(last[0], last[1], c), last[1] + c if c != " " else "  ", (out, c)
                else:
                    total, key, more = score + cost, last, out
                if key not in new or total > new[key][0]:
                    new[key] = (total, more)
        states = new
    _, out = max(((score + (model.logp(last[0], last[1], " ") if last[1] != " " else 0.0), out) for last, (score, out) in states.items()), key=lambda x: x[0])
    found: list[str] = []
    while out:
        out, c = out
        found.append(c)
    return "".join(reversed(found)).split()


@dataclass
class Toxic:
    model: CharModel
    weights: dict[str, float]
    bias: float


def plain(text: str) -> str:
    """Lower case, without invisible characters; wide and look-alike letters replaced in words mixed with Latin ones."""
    text = _HIDDEN.sub("", text.lower())
    if _WIDE.search(text):
        text = unicodedata.normalize("NFKC", text).lower()
        text = re.sub(r"[^\W\d_]*[a-z][^\W\d_]*", lambda m: m[0].translate(LOOKALIKE), text)
    return text


def squeeze(word: str) -> str:
    return _DOUBLE.sub(r"\1", word)


def stems(word: str):
    """The word's beginnings, as features."""
    return [word[:n] + "-" for n in STEMS if len(word) > n]


def suspicious(chunk: str) -> tuple[str, bool]:
    """The chunk without punctuation around it, and whether signs or repetitions make it a lattice."""
    core = chunk if chunk.isalpha() else _HEAD.sub("", _TAIL.sub("", chunk))
    return core, bool(_TRIPLE.search(core) or not core.isalpha() and _AMONG.search(core))


def spaced(text: str):
    """Stretches of single characters, without and with a last fragment."""
    for m in _SPACED.finditer(text):
        yield m[1]
        if m[2]:
            yield m[0]


def features(text: str | None, model: CharModel) -> set[str]:
    """All words of the plain and the restored text, word beginnings ("begi-"), and those of several words ("begi--")."""
    text = plain(text or "")
    words = set(_LETTERS.findall(text))
    for chunk in set(text.split()):
        core, lattice = suspicious(chunk)
        if lattice:
            words.update(restore(core, model))
    for stretch in spaced(text):
        words.update(restore(stretch, model))
    shared = Counter(s for w in words for s in stems(w))
    return words | set(shared) | {s + "-" for s, n in shared.items() if n > 1}


class Scorer(dict):
    """chunk -> its weighted words, and (beginning, word) of weighted beginnings; emptied when full, long chunks are not kept."""

    def __init__(self, toxic: Toxic, limit: int = 300_000):
        super().__init__()
        self.toxic, self.limit = toxic, limit
        self.stems = {w.rstrip("-") + "-" for w in toxic.weights if w.endswith("-")}
        self.squeezed = {squeeze(w): w for w in sorted(toxic.weights) if not w.endswith("-")}
        self.longest = max(map(len, self.squeezed), default=0)
        self.starts = {w[:i] for w in self.squeezed for i in range(1, len(w))} | {w[:i] for w in self.stems for i in range(1, len(w))}

    def weighted(self, words) -> frozenset:
        weights, beginnings = self.toxic.weights, self.stems
        out = [w for w in words if w in weights]
        if beginnings:
            out += [(s, w) for w in words for s in stems(w) if s in beginnings]
        return frozenset(out)

    def restored(self, stretch: str) -> frozenset:
        """What tells in the restored stretch; how often a letter is doubled no longer counts."""
        words = restore(stretch, self.toxic.model)
        return self.weighted([*words, *(w for w in map(self.squeezed.get, map(squeeze, words)) if w)])

    def joins(self, core: str) -> bool:
        """Whether letter groups next to each other, taken together, make a telling word."""
        groups = _LETTERS.findall(core)
        for i in range(len(groups)):
            said = groups[i]
            for g in groups[i + 1 :]:
                said += g
                if len(squeeze(said)) > self.longest:
                    break
                if squeeze(said) in self.squeezed:
                    return True
        return False

    def __missing__(self, chunk: str) -> frozenset:
        core, lattice = suspicious(chunk)
        found = self.weighted((core,) if core.isalpha() else _LETTERS.findall(core))
        if not found and not lattice:  # doubled letters and separators: only where they can hide a telling word
            if core.isalpha():
                lattice = _DOUBLE.search(core) and squeeze(core) in self.squeezed
            else:
                lattice = _DOUBLE.search(core) and any(squeeze(w) in self.squeezed for w in _LETTERS.findall(core)) or _JOINED.search(core) and self.joins(core)
        if lattice:
            found |= self.restored(core)
        if core != chunk and not found and _AMONG.search(rest := _HEAD.sub("", chunk).rstrip(".,;:?")) and rest != core:
            # Signs at the end may be a word's last letters, where the letters before them begin a telling one.
            if not core.isalpha() or core in self.starts or squeeze(core) in self.starts:
                found |= self.restored(rest)
        if len(chunk) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = found
        return found

    def words(self, text: str | None) -> set[str]:
        """The weighted features of a text."""
        if not text or not self.toxic.weights:
            return set()
        text = plain(text)
        found: set = set()
        for hit in map(self.__getitem__, set(text.split())):
            if hit:
                found |= hit
        for stretch in spaced(text):
            found |= self.restored(stretch)
        begun = Counter(f[0] for f in found if type(f) is tuple)
        out = {f for f in found if type(f) is str} | set(begun) | {s + "-" for s, n in begun.items() if n > 1}
        return {f for f in out if f in self.toxic.weights}

    def __call__(self, text: str | None) -> float:
        z = self.toxic.bias + sum(self.toxic.weights[w] for w in sorted(self.words(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def tails(n: int, p: float) -> np.ndarray:
    """P(at least k of n) for k = 0..n, each with probability p."""
    log_factorial = np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]
    k = np.arange(n + 1)
    chance = np.exp(log_factorial[n] - log_factorial - log_factorial[::-1] + k * math.log(p) + (n - k) * math.log1p(-p))
    return np.minimum(1.0, chance[::-1].cumsum()[::-1])


def telling(counts: list[tuple[str, int, int]], seen: dict[int, int], p: float, most: int, false: float) -> list[str]:
    """The features of (feature, texts, toxic texts) that speak for the class, at most `most`, surest first.

    A feature's place is its chance of being in so many toxic texts if it told nothing. So many are
    taken that, of the features in `seen` (texts -> number of features in so many), those that get
    as far by chance are a share of `false` at most: few labels give few features and not none.
    """
    if not 0 < p < 1:
        return []
    tail = {m: tails(m, p) for m in {*seen, *(m for _, m, _ in counts)}}
    order = sorted((float(tail[m][k]), -k, f) for f, m, k in counts if k >= 2 and k > m * p)[:most]
    for i in range(len(order), 0, -1):
        by_chance = 0.0
        for m, n in seen.items():
            at = np.searchsorted(-tail[m], -order[i - 1][0] * (1 + 1e-9))  # tails fall
            by_chance += n * (tail[m][at] if at <= m else 0.0)
        if by_chance <= false * i:
            return [f for *_, f in order[:i]]
    return []


def train(rows: list[tuple[list[str], int]], names: list[str], ridge: float = 0.3, steps: int = 60) -> tuple[dict[str, float], float]:
    """Logistic weights of the named features and the intercept: both classes weigh alike, and the ridge,
    which does not grow with the rows, holds the weights small while the labels are few."""
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        return {}, 4.0 if rows and ones else -4.0
    if not names:  # nothing tells the classes apart: every text is of the larger one
        return {}, 4.0 if 2 * ones > len(rows) else -4.0
    number = {w: i for i, w in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for r, (words, _) in enumerate(rows):
        x[r, [number[w] for w in words]] = 1
    y = np.array([b for _, b in rows], float)
    share = np.where(y == 1, 0.5 / ones, 0.5 / (len(rows) - ones)) * len(rows)
    beta, keep = np.r_[np.zeros(len(names)), -1.0], np.r_[np.full(len(names), ridge), 1e-3]
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (share * (q - y)) + keep * beta
        h = (x * (share * q * (1 - q))[:, None]).T @ x + np.diag(keep)
        move = np.linalg.solve(h, g)
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return dict(zip(names, map(float, beta[:-1]), strict=True)), float(min(beta[-1], -0.1))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most: int = 512, false: float = 0.5, held: int = 200_000) -> Toxic:
    """Weights fitted on at most per_class labelled rows of each class, letters counted over all documents.

    The rows are taken by a hash of their id; what a row has of features is counted by the executors. To
    the driver come the corpus's distinct trigrams, at most 8 * most features with their counts, how
    many features are in how many rows, and which of at most `most` features each fitted row has.
    """
    model = char_model(corpus_trigrams(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # distinct trigrams of letters
    sample, _ = fitting_sample(docs.select("doc_id", "text"), labels, "toxic", per_class)
    sample = materialise(sample.select("text", "label"), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    total = sum(sizes.values())

    def count(batches):
        mine: dict[str, list[int]] = {}

        def flush():
            columns = [pa.array(mine, pa.string()), pa.array([n for n, _ in mine.values()], pa.int64()), pa.array([k for _, k in mine.values()], pa.int64())]
            mine.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "n", "k"])

        for batch in batches:
            for s, y in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                for f in features(s, shared.value):
                    now = mine.setdefault(f, [0, 0])
                    now[0] += 1
                    now[1] += y
                if len(mine) >= held:
                    yield flush()
        if mine:
            yield flush()

    counted = sample.mapInArrow(count, T.StructType([T.StructField("feature", T.StringType()), T.StructField("n", T.LongType()), T.StructField("k", T.LongType())]))
    counted = materialise(counted.groupBy("feature").agg(F.sum("n").cast("int").alias("n"), F.sum("k").cast("int").alias("k")).where("n > 1"), "toxic-features")
    p = sizes.get(1, 0) / max(1, total)
    names: list[str] = []
    if 0 < p < 1:
        seen = {r["n"]: r["count"] for r in counted.groupBy("n").count().collect()}
        z = (F.col("k") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
        best = counted.where(F.col("k") >= 2).orderBy(z.desc(), "feature").limit(8 * most).collect()
        names = telling([tuple(r) for r in best], seen, p, most, false)
    weights, bias = train([], names)
    if total:
        wanted = frozenset(names)

        def chosen(batches):
            for batch in batches:
                found = [sorted(wanted & features(s, shared.value)) for s in texts(batch)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], names=["found", "label"])

        got = sample.mapInArrow(chosen, T.StructType([T.StructField("found", T.ArrayType(T.StringType())), T.StructField("label", T.IntegerType())])).toArrow()
        rows = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
        weights, bias = train(rows, names)
    return Toxic(model, weights, bias)


def score(docs: DataFrame, toxic: Toxic, cut: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= cut).

    Null and empty texts get the score of a text without a telling word; input columns named like a
    result column are replaced; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(toxic)  # trigrams of letters and the weighted features
    token = uuid.uuid4().hex

    def make():
        scorer = kept(token, lambda: Scorer(shared.value))

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [scorer(s) for s in texts(batch)]
            return appended(batch, {"score": pa.array(out, pa.float64()), "predicted": pa.array([int(p >= cut) for p in out], pa.int32())})

        return fn

    return map_arrow(docs, make, with_columns(docs.schema, [("score", T.DoubleType()), ("predicted", T.IntegerType())]))
