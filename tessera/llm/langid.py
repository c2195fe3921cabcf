"""Language spans: script ranges narrow the candidates, Viterbi over word scores labels the words.

A word's score in a language is its log likelihood under hashed character 1- to 3-grams of that language,
relative to the best language and bounded below. Scripts are told by code-point ranges; a word can
only be of the languages in which its script was seen. The best path of labels pays a penalty at
every change of language.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkTable
from .common import appended, kept, map_arrow, remainder, with_columns

# First and last code points of letters of a script (Unicode blocks).
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
GRAMS = 1 << 15
FLOOR = -10.0


def script(word: str) -> str:
    at = ord(word[0])
    return next((name for name, lo, hi in SCRIPTS if lo <= at <= hi), "other")


def kinds_of(code: np.ndarray) -> np.ndarray:
    """Row of SCRIPTS of each code point; -1 for others."""
    low, high = np.array([x[1] for x in SCRIPTS]), np.array([x[2] for x in SCRIPTS])
    at = np.searchsorted(low, code, side="right") - 1
    return np.where((at >= 0) & (code <= high[at]), at, -1)


def split(rows: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of white-space chunks of each text, all chunks); a null text has none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(pc.utf8_trim_whitespace(rows.cast(pa.large_string())), ""))
    flat = lists.flatten()
    size = np.asarray(pc.list_value_length(lists), np.int64)
    if (size == 1).any():  # an empty text splits into one empty chunk
        full = np.asarray(pc.greater(pc.binary_length(flat), 0))
        if not full.all():
            size, flat = size - (np.add.reduceat(~full, np.cumsum(size) - size) > 0), flat.filter(pa.array(full))
    return size, flat


def letters(chunk: str) -> str:
    """The letters of a chunk in lower case."""
    return chunk.lower() if chunk.isalpha() else "".join(filter(str.isalpha, chunk)).lower()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' character 1- to 3-grams with marked ends, number of buckets of each word)."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    two = code[:-1] * np.uint64(0x9E3779B1) + code[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + code[2:] * np.uint64(0x27D4EB2F)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    mix = lambda h, n: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)) % np.uint64(GRAMS // 2) + np.uint64(n * GRAMS // 4)
    out = np.stack([mix(code, 0), np.r_[mix(two, 1), np.zeros(1, np.uint64)], np.r_[mix(three, 2), np.zeros(2, np.uint64)]], axis=1).astype(np.int64)
    keep = np.ones(out.shape, bool)  # no n-gram reaches over a word's end
    keep[end - 1, 1:] = False
    keep[end - 2, 2] = False
    return out[keep], 3 * size - 3


@dataclass
class Languages:
    names: list[str]
    logp: np.ndarray  # (GRAMS, languages)
    allowed: dict[str, np.ndarray]  # script -> which languages

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of each word relative to its best candidate's 0; all 0 where the script was never seen."""
        at, size = grams(words)
        s = np.add.reduceat(self.logp[at], np.cumsum(size) - size, axis=0) / 3
        kinds = kinds_of(np.fromiter((ord(w[0]) for w in words), np.int64, len(words)))
        for kind in np.unique(kinds):
            rows = kinds == kind
            allowed = self.allowed.get(SCRIPTS[kind][0] if kind >= 0 else "other")
            s[rows] = 0 if allowed is None else np.where(allowed, s[rows], -np.inf)
        return np.maximum(s - s.max(axis=1, keepdims=True), FLOOR)


def fit(docs: DataFrame, per_language: int = 2500, held_out: tuple[int, int] = (4, 2), languages: int = 512, script_share: float = 0.01, seed: int = 8) -> Languages:
    """Learned from about per_language documents of each lang (by a hash of the id), whole texts.

    Only rows with an id, a text and a lang whose crc32(doc_id as text) mod held_out[0] is not
    held_out[1]. The `languages` langs with the most such rows are learned (ties by name), so that a
    column full of stray values cannot exhaust the driver, which gets a table of GRAMS counts for
    each. A language is a candidate for the words of a script if more than script_share of its own
    words are in that script: below, foreign names and quotations would make every language a
    candidate everywhere. A text in a script that no language uses so much can be any language.
    """
    rest = remainder(F.col("doc_id"), held_out[0])
    known = docs.where(F.col("lang").isNotNull() & (rest >= 0) & (rest != held_out[1])).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    names = sorted(counts)
    if not names:
        return Languages([], np.zeros((GRAMS, 0)), {})
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, per_language / counts[n])))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(F.col("text").isNotNull() & (draw < share[F.col("lang")]))

    def count(batches):
        grammed: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        for batch in batches:
            words: dict[str, dict[str, int]] = {}
            for lang in pc.unique(batch.column(0)).to_pylist():
                _, flat = split(batch.column(1).filter(pc.equal(batch.column(0), lang)))
                said = pc.value_counts(flat)
                words[lang] = dict(zip(said.field(0).to_pylist(), said.field(1).to_pylist(), strict=True))
            for lang, mine in words.items():
                total = grammed.setdefault(lang, np.zeros(GRAMS, np.int64))
                said: dict[str, int] = {}
                for chunk, n in mine.items():
                    if w := letters(chunk):
                        said[w] = said.get(w, 0) + n
                if said:
                    at, size = grams(list(said))
                    total += np.bincount(at, np.repeat(list(said.values()), size), GRAMS).astype(np.int64)
                for w, n in said.items():
                    key = lang, script(w)
                    scripts[key] = scripts.get(key, 0) + n
        for lang, total in grammed.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.nulls(len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "script", "gram", "n"])
        if scripts:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in scripts], pa.string()), pa.array([b for _, b in scripts], pa.string()), pa.array([-1] * len(scripts), pa.int32()), pa.array(list(scripts.values()), pa.int64())], names=["lang", "script", "gram", "n"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("script", T.StringType()), T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())])
    got = sample.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "script", "gram").agg(F.sum("n").alias("n")).toArrow()
    number = {n: i for i, n in enumerate(names)}
    seen = np.zeros((GRAMS, len(names)))
    by_script: dict[str, np.ndarray] = {}
    for lang, kind, gram, n in zip(*(c.to_pylist() for c in got.columns), strict=True):
        if kind is None:
            seen[gram, number[lang]] = n
        else:
            by_script.setdefault(kind, np.zeros(len(names)))[number[lang]] = n
    logp = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * GRAMS))
    total = sum(by_script.values(), np.zeros(len(names)))
    allowed = {k: v > script_share * np.maximum(total, 1) for k, v in by_script.items()}
    return Languages(names, logp, {k: v for k, v in allowed.items() if v.any()})


def paths(many: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Labels of the best path of each text's rows of scores, with a penalty at each change.

    Where one label leads in consecutive rows by more than twice the penalty in all, every best path
    takes it there: two changes cost less than the run gains. Such rows cut the texts into segments
    that do not depend on each other; the recursion steps through the rest of all texts together,
    longest segment first. Rows of equal scores take the label of the next row that has a say.
    """
    if not many:
        return []
    size = np.fromiter(map(len, many), np.int64, len(many))
    every, owner = np.concatenate(many), np.repeat(np.arange(len(many)), size)
    says = np.flatnonzero(every.max(axis=1) > every.min(axis=1)) if len(every) else np.empty(0, np.int64)
    out = np.zeros(len(every), np.int64)
    if len(says):
        label = _segments(every[says].astype("f8"), owner[says], penalty)
        after = np.minimum(np.searchsorted(says, np.arange(len(every))), len(says) - 1)
        before = np.maximum(np.searchsorted(says, np.arange(len(every)), side="right") - 1, 0)
        out = np.where(owner[says[after]] == owner, label[after], np.where(owner[says[before]] == owner, label[before], 0))
        out[says] = label
    return np.split(out, np.cumsum(size)[:-1])


def _segments(scores: np.ndarray, owner: np.ndarray, penalty: float) -> np.ndarray:
    best, own = scores.argmax(axis=1), np.arange(scores.shape[1])
    two = np.partition(scores, -2, axis=1)[:, -2:]
    lead = two[:, 1] - two[:, 0]
    opens = np.r_[True, owner[1:] != owner[:-1]]
    run = np.flatnonzero(opens | np.r_[True, best[1:] != best[:-1]] | (lead == 0) | np.r_[False, lead[:-1] == 0])
    which = np.repeat(np.arange(len(run)), np.diff(np.r_[run, len(best)]))
    so_far, total = np.cumsum(lead), np.add.reduceat(lead, run)
    so_far -= (so_far[run] - lead[run])[which]
    fixed = (np.maximum(so_far, total[which] - so_far + lead) > 2 * penalty) & (lead > 0)
    start = np.flatnonzero(opens | fixed)
    size = np.diff(np.r_[start, len(best)])
    bound = np.r_[fixed, False][start + size] & ~np.r_[opens, True][start + size]
    end = np.where(bound, np.r_[best, 0][start + size], best[start])  # the label after the segment
    low, high = np.minimum.reduceat(best, start), np.maximum.reduceat(best, start)
    out = np.repeat(best[start], size)
    todo = np.flatnonzero((low != high) | (end != low))
    todo = todo[np.argsort(-size[todo], kind="stable")]
    if not len(todo):
        return out
    start, size, bound, end = start[todo], size[todo], bound[todo], end[todo]
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # segments with more than t rows
    row, back = np.arange(len(size)), []
    now = np.where(fixed[start][:, None] & (own != best[start][:, None]), -np.inf, scores[start])
    for t in range(1, size[0]):
        a = live[t]
        head = now[:a]
        top = head.argmax(axis=1)
        changed = (head[row[:a], top] - penalty)[:, None]
        stay = head >= changed
        back.append(np.where(stay, own, top[:, None]).astype(np.int16))
        now[:a] = np.where(stay, head, changed) + scores[start[:a] + t]
    top = now.argmax(axis=1)
    label = np.where(bound & (now[row, end] >= now[row, top] - penalty), end, top)
    for t in range(size[0] - 1, 0, -1):
        a = live[t]
        out[start[:a] + t] = label[:a]
        label[:a] = back[t - 1][row[:a], label[:a]]
    out[start] = label
    return out


def path(scores: np.ndarray, penalty: float) -> np.ndarray:
    return paths([scores], penalty)[0]


class Labeller:
    def __init__(self, model: Languages, penalty: float):
        self.model, self.penalty = model, penalty
        self.table = ChunkTable(len(model.names) + 1)

    def rows(self, distinct: list[str]) -> np.ndarray:
        """(letters, scores) of each chunk; chunks that are not in the table yet are scored together."""
        self.table.make_room()
        new = [c for c in dict.fromkeys(distinct) if c not in self.table]
        word = [letters(c) for c in new]
        known = list(dict.fromkeys(filter(None, word)))
        values = np.zeros((len(known) + 1, len(self.model.names) + 1))  # the last is for chunks without letters
        if known:
            values[:-1] = np.c_[[len(w) for w in known], self.model.words(known)]
        number = {w: i for i, w in enumerate(known)} | {"": len(known)}
        self.table.fill(new, values[[number[w] for w in word]])
        return self.table.values[np.fromiter(map(self.table.__getitem__, distinct), np.int64, len(distinct))]

    def labels(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label of each chunk, its letters, its scores)."""
        rows = self.rows(chunks)
        return path(rows[:, 1:], self.penalty), rows[:, 0], rows[:, 1:]

    def many(self, rows: pa.Array) -> list[tuple[str, float]]:
        if not self.model.names:
            return [("und", 0.0)] * len(rows)
        size, flat = split(rows)
        coded = flat.dictionary_encode()
        found = self.rows(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        each = np.split(found, np.cumsum(size)[:-1])
        label = paths([x[:, 1:] for x in each], self.penalty)
        return [self.one(a, b) for a, b in zip(label, each, strict=True)]

    def one(self, label: np.ndarray, rows: np.ndarray) -> tuple[str, float]:
        weight, scores = rows[:, 0], rows[:, 1:]
        if not weight.any():
            return "und", 0.0
        letters_of = np.bincount(label, weight, len(self.model.names))
        top = int(letters_of.argmax())
        total = scores[label == top].sum(axis=0, dtype="f8")
        sure = 1 / np.exp(np.clip((total - total[top]) / np.sqrt(len(rows)), -50, 50)).sum()
        return self.model.names[top], float(np.clip(letters_of[top] / weight.sum() * sure, 0, 1))

    def spans(self, text: str | None) -> list[dict]:
        """Runs of one language as character ranges."""
        found = list(re.finditer(r"\S+", text or "")) if self.model.names else []
        if not found:
            return []
        label, weight, _ = self.labels([m[0] for m in found])
        if not weight.any():
            return []
        edge = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        return [{"start": found[a].start(), "end": found[b - 1].end(), "lang": self.model.names[label[a]]} for a, b in zip(edge, [*edge[1:], len(label)], strict=True)]


def parts(rows: pa.Array, most: int = 2 << 20):
    """Slices of about `most` bytes of text, or of one text that is longer."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(rows), 0), np.int64))
    at = np.flatnonzero(np.r_[True, size[1:] // most != size[:-1] // most]) if len(rows) else []
    for lo, hi in zip(at, [*at[1:], len(rows)], strict=True):
        yield rows.slice(lo, hi - lo)


def identify(docs: DataFrame, model: Languages, penalty: float = 8.0, with_spans: bool = False) -> DataFrame:
    """docs with lang_pred, score (and spans: character ranges with their language).

    und with score 0 where the text is null or has no letter, or nothing was learned; else always a
    learned lang. Input columns named like a result column are replaced; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS numbers a language
    extra = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))

    token = uuid.uuid4().hex

    def make():
        label = kept(token, lambda: Labeller(shared.value, penalty))

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(batch.schema.get_field_index("text"))
            out = [x for part in parts(rows) for x in label.many(part)]
            more = {"lang_pred": pa.array([a for a, _ in out], pa.string()), "score": pa.array([b for _, b in out], pa.float64())}
            if with_spans:
                more["spans"] = pa.array([label.spans(s) for s in rows.to_pylist()], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
            return appended(batch, more)

        return fn

    return map_arrow(docs, make, with_columns(docs.schema, extra + ([("spans", span)] if with_spans else [])))
