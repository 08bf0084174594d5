"""How demanding the prose of a text is, by regularised ordinal regression calibrated to graded text.

Prose is what is left without code, logs, tables, headings and identifiers. Each sentence gets
features of lexical diversity, word rarity, connectives, clause depth and length; a proportional-odds
model over them gives its level. As graded texts mix sentences of neighbouring levels, the model is
refitted on its own sentence levels, held within one level of the text's. The level of a text comes
from the centre of its words' levels, with bounds calibrated on the graded texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
FEATURES = 17
#: Graded texts the model is fitted on, at most; the graded table is a fixed one.
MOST_SAMPLES = 5_000
#: Strength of the penalty, and rounds of refitting on the model's own sentence levels.
PENALTY = 1.0
ROUNDS = 4
#: Spread of a feature that is taken at least, so that one that hardly varies in the graded texts gets no huge weight.
LEAST_SPREAD = 0.02
#: Weight of the features that stand for sentences of an unseen make.
UNSEEN = 0.3
#: Counters of the documents that hold a word, by the word's hash: the size of the table, whatever the corpus.
WORD_BUCKETS = 1 << 18
#: Cleaned sentences and words whose score a worker remembers: a bound of memory, without effect on results.
REMEMBERED = 200_000

# Conjunctions and conjunctive adverbs as grammars list them. Coordinating and temporal ones, then those
# that open a subordinate clause, then those of written argument.
CONNECTIVES = {
    "en": (
        "and but or so then yet also when if because after before while first next finally".split(),
        "although as since though that unless until whether which who whom whose where wherever whenever than once".split(),
        "accordingly albeit consequently conversely furthermore hence however inasmuch insofar likewise moreover namely nevertheless nonetheless notwithstanding otherwise provided thereby therefore thus whereas whereby wherein whereupon".split(),
    ),
    "de": (
        "und aber oder denn dann auch wenn weil jetzt zuerst danach".split(),
        "als bevor bis da damit dass nachdem ob obwohl seit sobald solange während welche welcher welches der die das wo ohne".split(),
        "allerdings anderenfalls andererseits demgemäß demnach demzufolge dennoch deshalb falls folglich gleichwohl hingegen indem indessen infolgedessen insofern insoweit jedoch mithin obgleich sofern somit soweit wenngleich weshalb wobei wodurch zumal".split(),
    ),
    "es": (
        "y e o u ni pero luego también si porque cuando ahora primero después".split(),
        "antes aunque como donde hasta mientras para pues que quien quienes según sin".split(),
        "asimismo conque consiguiente cual cuales cuya cuyas cuyo cuyos embargo empero entretanto excepto obstante salvo siempre sino tampoco".split(),
    ),
}
LANGUAGES = tuple(CONNECTIVES)
_BITS = 24
_FIELD = (1 << _BITS) - 1

_FENCED = re.compile(r"(?:```|~~~)[\s\S]*?(?:```|~~~|\Z)")
_ROW = re.compile(r"\|[^|\n]*\|(?:[^|\n]*\|)+")
_LOG = re.compile(r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d\S*(?:\s+\[?(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL|CRITICAL|NOTICE)\]?:?)?(?:\s+[\w.$/-]+:)?(?:\s+\w+)?(?:\s+[\w.]+=\S+)+")
_SKIP_LINE = re.compile(
    r"""(?x)\s*(?:>\s*)*(?:
      \| | \+[-=+]{3,} | [-=_*~|:+\s]+$
      | \[?\d{4}-\d\d-\d\d[T\s]\d\d:\d\d | \[?\d\d:\d\d:\d\d\b | \[?(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL|CRITICAL)\b[\]:\s]
      | (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d+\s+\d\d:\d\d:\d\d
      | Traceback\b | File\s"[^"]*",\sline | at\s+[\w.$<>]+\( | diff\s--git | @@\s | [<>=|]{7}
      | (?:async\s+)?def\s+\w+\s*\( | class\s+\w+[^.]*[:{]\s*$ | (?:export\s+)?(?:default\s+)?(?:async\s+)?function\b[^.]*\( | (?:export\s+)?(?:const|let|var)\s+[\w{\[].*=
      | import\s+[\w{*].*(?:from\b|;|$) | from\s+[.\w]+\s+import\b | (?:if|for|while|switch|catch)\s*\( | @\w+ | [{}()\[\];,\s]+$ | \} | //\s | /\* | \*/ | \#! | \$\s | >>>\s | "[\w-]+"\s*:
    )"""
)
_CODE_TAIL = re.compile(r"[{;]\s*$|^\s*\w[\w.]*\s*=\s*\S|^\s*\w[\w.]*\([^)]*\)\s*;?\s*$|^\s*</?\w+[^>]*>\s*$")
_HEADING = re.compile(r"\s*(?:>\s*)*#{1,6}\s+(?:\d+(?:\.\d+)+\s*|\[[^\]]*\]\s*)?")
_MARKER = re.compile(r"^\s*(?:>\s*)*(?:(?:[-*+•]|\d{1,3}[.)]|\[[ xX]\])\s+)*(?:>\s*)*")
_BULLET = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]|\d{1,3}[.)])\s")
_TICKS = re.compile(r"`[^`]*`")
_NOISY = re.compile(r"[_(/<@{`]|[a-z][A-Z]|\d[a-f]|[a-f]\d")
_NOISE = re.compile(r"https?://\S+|www\.\S+|</?\w[^<>\n]{0,200}>|\{@[^}]*\}|[\w.+-]+@[\w-]+\.\w+|(?:[\w.-]+/)+[\w.-]+|\b(?=\w*(?:_|[a-z0-9][A-Z]))\w+(?:\(\))?|\w+\(\)|\b[0-9a-f]{7,}\b|`")
_END = re.compile(r"(?<=[.!?…])[\"')\]»“”’]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_OTHER = re.compile(r"[Ͱ-ᇿ぀-ヿ㐀-鿿가-힯]")
_PARTS = re.compile(r"[-'’]")
_PAUSE = re.compile(r"[,;:()–—]")


def prose(text: str) -> list[str]:
    """The cleaned sentences of a text's prose: no code, logs, tables or headings, identifiers blanked.

    Marked-up parts are found within a line as well, since white space may have been lost. What
    follows a heading on its own line is prose if it has a sentence's end.
    """
    if "```" in text or "~~~" in text:
        text = _FENCED.sub("\n\n", text)
    if "|" in text:
        text = _ROW.sub("\n\n", text)
    if "=" in text:
        text = _LOG.sub("\n\n", text)
    out: list[str] = []
    pending: list[str] = []
    for line in text.splitlines():
        bare = line.strip()
        stop = not bare
        if not stop and bare[0] == "#":
            bare = _HEADING.sub("", line, count=1).strip()
            stop = len(bare) < 40 and not bare.endswith((".", "!", "?"))
        elif not stop:
            stop = _SKIP_LINE.match(line) is not None or (bare[-1] not in ".!?" and _CODE_TAIL.search(line) is not None)
        if pending and (stop or _BULLET.match(line)):
            out += _END.split(" ".join(pending))
            pending = []
        if not stop:
            pending.append(_MARKER.sub("", bare, count=1))
    if pending:
        out += _END.split(" ".join(pending))
    clean = []
    for x in out:
        if "`" in x:
            x = _TICKS.sub(" ", x)
        if _NOISY.search(x):
            x = _NOISE.sub(" ", x)
        x = x.strip()
        if x:
            clean.append(x)
    return clean


Info = tuple[float, int, int, int, int, int, float]  # difficulty, length, long, plain, deep or formal, formal, rarity


class Rarity:
    """How rare a word is: the logarithm of all documents over those that hold it, from counters by the word's hash.

    Of a word with hyphens or apostrophes the rarest part counts. Words that share a counter look more
    frequent than they are.
    """

    def __init__(self, counts: np.ndarray | None = None, documents: int = 0):
        self.table = None if counts is None else np.log((documents + 1.0) / (counts + 1.0)).astype(np.float32)

    def of(self, word: str) -> float:
        if self.table is None:
            return 0.0
        return max(float(self.table[xxhash.xxh64_intdigest(p.encode(), 42) % len(self.table)]) for p in _PARTS.split(word))


def word_rarity(docs: DataFrame, text: str = "text", buckets: int = WORD_BUCKETS) -> Rarity:
    """Document frequencies of all words of all documents, counted in the JVM; only the table of counters reaches the driver."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))).alias("w")).where("w <> ''")
    rows = words.groupBy(F.expr(f"cast(pmod(xxhash64(w), {buckets}) as int)").alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(buckets)
    counts[rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    return Rarity(counts, docs.where(F.col(text).isNotNull()).count())


@dataclass
class Model:
    """Lexicons and weights; plain values only, so that it is small and can be sent to workers."""

    words: dict[str, dict[str, Info]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)  # word -> a one in the field of each language that has it
    unknown: dict[str, tuple[float, float]] = field(default_factory=dict)  # difficulty of other words by length: base, slope
    weights: dict[str, list[float]] = field(default_factory=dict)  # for raw features; the last is the constant
    cuts: dict[str, list[float]] = field(default_factory=dict)
    bounds: dict[str, list[float]] = field(default_factory=dict)  # between the centres of whole texts
    rarity: Rarity = field(default_factory=Rarity)
    new: dict[str, dict[str, Info]] = field(default_factory=dict)  # words outside the lexicon seen so far

    def sentence(self, sentence: str) -> tuple[str | None, float, int, int]:
        """(language, score, words, words of other languages) of a cleaned sentence."""
        words = _WORD.findall(sentence.lower())
        n = len(words)
        if not n:
            return None, 0.0, 0, 0
        if not sentence.isascii():
            other = len(_OTHER.findall(sentence))
            if other * 3 > len(sentence):
                return None, 0.0, 0, max(1, other // 2) if _WIDE.search(sentence) else n
        hits = sum(map(self.marks.get, words, repeat(0)))
        best, most = None, 0
        for lang in LANGUAGES:
            if hits & _FIELD > most and lang in self.weights:
                best, most = lang, hits & _FIELD
            hits >>= _BITS
        if most * 4 < n:
            return None, 0.0, 0, n
        w = self.weights[best]
        new = self.new.setdefault(best, {})
        if len(new) > REMEMBERED:
            new.clear()
        x = features(sentence, words, self.words[best], new, self.unknown[best], _SETS[best], self.rarity)
        return best, w[-1] + sum(a * b for a, b in zip(x, w, strict=False)), n, 0

    def level(self, sentence: str) -> tuple[str | None, float, int, int]:
        """(language, expected level, words, words of other languages)."""
        lang, score, n, other = self.sentence(sentence)
        if lang is None:
            return None, 0.0, n, other
        level = 1.0
        for cut_ in self.cuts[lang]:
            gap = cut_ - score
            level += 1 / (1 + math.exp(gap)) if -40 < gap < 40 else float(gap < 0)
        return lang, level, n, 0


def _info(word: str, difficulty: float, sets: tuple, rarity: Rarity) -> Info:
    plain, deep, formal = sets
    return difficulty, len(word), len(word) >= 9, word in plain, word in deep or word in formal, word in formal, rarity.of(word)


def features(sentence: str, words: list[str], known: dict[str, Info], fresh: dict[str, Info], unknown: tuple[float, float], sets: tuple, rarity: Rarity) -> list[float]:
    """Lexical diversity, length, graded difficulty of the words (mean, top, upper quarter, median, share ungraded), connectives of three kinds, clause depth, and word rarity (mean, top, upper quarter).

    fresh: words outside the lexicon, filled in as they come.
    """
    n = len(words)
    total = top = 0.0
    chars = longest = long = plain = deeper = formal = new = 0
    hard, rare = [], []
    for w in words:
        i = known.get(w)
        if i is None:
            new += 1
            i = fresh.get(w)
            if i is None:
                i = fresh[w] = _info(w, unknown[0] + unknown[1] * min(14, len(w)), sets, rarity)
        d, size, is_long, p, q, f, r = i
        hard.append(d)
        rare.append(r)
        total += d
        chars += size
        if size > longest:
            longest = size
        long += is_long
        plain += p
        deeper += q
        formal += f
    hard.sort()
    rare.sort()
    pauses = len(_PAUSE.findall(sentence))
    return [
        len(set(words)) / n, math.log(n), chars / n, longest, long / n, total / n, hard[-1], hard[(3 * n) // 4], hard[n // 2], new / n,
        plain / n, deeper / n, formal / n, math.log1p(pauses + deeper), sum(rare) / n, rare[-1], rare[(3 * n) // 4],
    ]


_SETS = {lang: tuple(frozenset(x) for x in lists) for lang, lists in CONNECTIVES.items()}


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cut points of a proportional-odds model with a ridge penalty, by gradient steps with momentum."""
    n, d = x.shape
    w = np.zeros(d)
    share = np.cumsum([weight[y == k].sum() for k in range(1, LEVELS)]) / weight.sum()
    share = np.clip(share, 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    first, second = [np.zeros(d), np.zeros(LEVELS - 1)], [np.zeros(d), np.zeros(LEVELS - 1)]
    total = weight.sum()
    for step in range(1, steps + 1):
        z = x @ w
        at = np.concatenate([[-np.inf], np.sort(cuts), [np.inf]])
        hi = 1 / (1 + np.exp(-np.clip(at[y] - z, -40, 40)))
        lo = 1 / (1 + np.exp(-np.clip(at[y - 1] - z, -40, 40)))
        hi[y == LEVELS], lo[y == 1] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        gw = (x * (dhi - dlo)[:, None]).sum(axis=0) / total + penalty * w / total
        gc = np.zeros(LEVELS - 1)
        for k in range(LEVELS - 1):
            gc[k] = (-(dhi[y == k + 1].sum()) + dlo[y == k + 2].sum()) / total
        for i, (value, grad) in enumerate(((w, gw), (cuts, gc))):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad * grad
            value -= 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return w, np.sort(cuts)


def _lexicon(rows: list[tuple[int, str, list[str]]], now: np.ndarray, use: np.ndarray, hide: set[str], sets: tuple, rarity: Rarity) -> tuple[dict[str, Info], tuple[float, float]]:
    """Difficulty of each word, the mean level of its sentences drawn to the middle; and that of unknown words by length."""
    total: Counter = Counter()
    count: Counter = Counter()
    for i in np.flatnonzero(use).tolist():
        for w in set(rows[i][2]):
            total[w] += float(now[i])
            count[w] += 1
    middle = float(now[use].mean()) if use.any() else 3.0
    known = {w: _info(w, (total[w] + middle) / (c + 1), sets, rarity) for w, c in count.items() if w not in hide}
    # words seen in few sentences stand for those never seen
    seldom = [(min(14, len(w)), total[w] / c) for w, c in count.items() if c <= max(3, len(rows) // 300)]
    if len(seldom) > 20:
        x, y = np.array(seldom).T
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / max(((x - x.mean()) ** 2).sum(), 1e-9))
        return known, (float(y.mean() - slope * x.mean()), slope)
    return known, (middle - 0.7, 0.1)


def fit(samples: Iterable[tuple[str, int, str]], rarity: Rarity | None = None, rounds: int = ROUNDS, folds: int = 5, hidden: float = 0.3, seed: int = 3) -> Model:
    """A model from graded texts (language, level 1 to 5, text); languages without texts have no levels.

    A sentence's features come from a lexicon of the other folds, in which a part of the words is
    hidden as well, so that the weights hold for sentences and words that no graded text has.
    """
    rarity = rarity or Rarity()
    model = Model(rarity=rarity)
    rng = np.random.default_rng(seed)
    by: dict[str, list[tuple[int, str, list[str]]]] = {}
    texts: dict[str, list[int]] = {}
    for at, (lang, level, text) in enumerate(samples):
        if lang in CONNECTIVES and text and level in range(1, LEVELS + 1):
            for s in prose(text):
                words = _WORD.findall(s.lower())
                if words:
                    by.setdefault(lang, []).append((level, s, words))
                    texts.setdefault(lang, []).append(at)
    for lang, rows in sorted(by.items()):
        sets = _SETS[lang]
        graded = np.array([r[0] for r in rows])
        # once texts are left out whole, and once sentences that begin alike, which are of one make
        by_text = np.array(texts[lang]) % folds
        by_make = np.array([crc32(" ".join(r[2][:2]).encode()) % folds for r in rows])
        now = graded.copy()
        weight = np.array([float(len(r[2])) ** 0.5 for r in rows])
        vocabulary = sorted({w for r in rows for w in r[2]})
        for _ in range(rounds):
            x = np.zeros((2 * len(rows), FEATURES))
            for f in range(folds):
                fresh: dict[str, Info] = {}
                known, other = _lexicon(rows, now, by_text != f, set(), sets, rarity)
                for i in np.flatnonzero(by_text == f).tolist():
                    x[i] = features(rows[i][1], rows[i][2], known, fresh, other, sets, rarity)
                part = {w for w, r in zip(vocabulary, rng.random(len(vocabulary)), strict=True) if r < hidden}
                fresh = {}
                known, other = _lexicon(rows, now, by_make != f, part, sets, rarity)
                for i in np.flatnonzero(by_make == f).tolist():
                    x[len(rows) + i] = features(rows[i][1], rows[i][2], known, fresh, other, sets, rarity)
            mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), LEAST_SPREAD)
            z = (x - mean) / scale
            w, cuts = fit_ordinal(z, np.concatenate([now, now]), np.concatenate([weight, UNSEEN * weight]))
            model.cuts[lang] = cuts.tolist()
            raw, w_last = w / scale, w
            model.weights[lang] = [*raw.tolist(), float(-(raw * mean).sum())]
            now = np.clip(np.searchsorted(cuts, z[: len(rows)] @ w) + 1, np.maximum(1, graded - 1), np.minimum(LEVELS, graded + 1))
        model.words[lang], model.unknown[lang] = _lexicon(rows, now, np.ones(len(rows), dtype=bool), set(), sets, rarity)
        for word in model.words[lang]:
            model.marks[word] = model.marks.get(word, 0) + (1 << _BITS * LANGUAGES.index(lang))
        # whole texts: the centre of their words' levels by weights and lexicons that haven't seen them
        expected = 1 + (1 / (1 + np.exp(np.clip(np.array(model.cuts[lang])[None, :] - (z[: len(rows)] @ w_last)[:, None], -40, 40)))).sum(axis=1)
        size = np.array([len(r[2]) for r in rows])
        of = np.array(texts[lang])
        whole: dict[int, list[float]] = {}
        for t in np.unique(of):
            mine = of == t
            whole.setdefault(int(graded[mine][0]), []).append(centre_of(list(zip(expected[mine].tolist(), size[mine].tolist(), strict=True)), int(size[mine].sum())))
        model.bounds[lang] = _bounds(whole)
    return model


def _bounds(whole: dict[int, list[float]]) -> list[float]:
    """The bound between each two levels that parts the graded texts with the fewest errors; the middle of all such bounds."""
    out: list[float] = []
    for k in range(1, LEVELS):
        low = np.sort([x for level, of in whole.items() if level <= k for x in of])
        high = np.sort([x for level, of in whole.items() if level > k for x in of])
        if not len(low) or not len(high):
            out.append(k + 0.5)
            continue
        every = np.unique(np.concatenate([low, high]))
        tries = np.concatenate([[every[0] - 0.5], (every[:-1] + every[1:]) / 2, [every[-1] + 0.5]])
        # errors of each kind count by the share of their side, so that the five levels' sizes don't move a bound
        wrong = (len(low) - np.searchsorted(low, tries)) / len(low) + np.searchsorted(high, tries) / len(high)
        best = tries[wrong <= wrong.min() + 1e-9]
        out.append(float((best[0] + best[-1]) / 2))
    return np.maximum.accumulate(out).tolist()


def centre_of(parts: list[tuple[float, int]], total: int) -> float:
    """Half way between mean and median of the levels of the words, from (level, words) of each sentence.

    The median is the level that most of the prose reaches; the mean keeps fine differences.
    """
    run, median = 0, 0.0
    for level, n in sorted(parts):
        run += n
        if 2 * run >= total:
            median = level
            break
    return (sum(level * n for level, n in parts) / total + median) / 2


def level_of(model: Model, text: str | None, known: dict) -> tuple[int | None, int, float | None]:
    """(level, words of prose, centre of the words' levels); no level without prose in a graded language."""
    if not text:
        return None, 0, None
    words: dict[str, int] = {}
    total = other = 0
    parts: list[tuple[float, int]] = []
    for s in prose(text):
        found = known.get(s)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[s] = model.level(s)
        lang, level, n, more = found
        other += more
        if lang is not None:
            total += n
            parts.append((level, n))
            words[lang] = words.get(lang, 0) + n
    if not total or other > total:
        return None, total, None
    lang = max(words, key=lambda k: (words[k], k))
    score = centre_of(parts, total)
    return bisect_right(model.bounds[lang], score) + 1, total, score


def read_samples(samples: DataFrame, most: int = MOST_SAMPLES) -> list[tuple[str, int, str]]:
    """The graded texts, at most so many, in order of their id."""
    rows = samples.where("text is not null and reading_level is not null and lang is not null").orderBy("sample_id").limit(most)
    return [(r["lang"], int(r["reading_level"]), r["text"]) for r in rows.select("lang", "reading_level", "text").collect()]


def levels(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reading_level int, words long, score double) of every row.

    reading_level is null for null and empty texts, texts without prose, and prose mostly in
    languages that have no graded texts. score is the centre of the levels of its words.
    The stated language isn't used. Whole texts are read; other columns are not. Word rarity comes from
    the document frequencies of all words of docs.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(read_samples(samples), word_rarity(docs, text)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            out = [level_of(model.value, t, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["k", "reading_level", "words", "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, reading_level int, words long, score double").withColumnRenamed("k", key)
