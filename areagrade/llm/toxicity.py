"""Toxicity: a noisy-channel decoder restores obfuscated words, then the restored text is scored."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.llm.wordhash import NO_WORD, SPACE, Words, buffers, byte_slices, word_slices
from areagrade.llm.workers import importable

FOLDS = 5
SAMPLE_ROWS = 4000  # labelled rows of each class the classifier is fitted on, at most
LEAST_DOCS = 3
LEAST_Z = 5.0  # standard errors by which the classes' shares of a feature differ
PREFIXES = (4, 5, 6, 7)
REPEATS = (2, 4)  # times that a word or beginning comes in a text, each a feature of its own

# What a sign may stand for besides itself (fixed values).
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SIGN_COST, SPLIT_COST, SINGLE_COST = -1.0, -2.0, -0.2
# Words are joined, and doubled letters made one, where the letter model finds that this much likelier (e ** 5 times).
LIKELIER = 5.0
SYMBOLS = 28  # blank, a to z, everything else
OTHER = 27

_CLASS = np.full(256, OTHER, dtype=np.int32)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _b in range(26):
    _CLASS[97 + _b] = _CLASS[65 + _b] = 1 + _b
# Sentence signs end a word as blanks do.
_CLASS[[ord(x) for x in ".,;:?\"'"]] = 0
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(x) for x in SIGNS]] = True
_JOINT = np.zeros(256, dtype=bool)
_JOINT[[ord(x) for x in ".-_~"]] = True
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_EDGE = re.compile(r"""^(?:[.,;:?%&#*("')!|+\-_~]|[$@]{3,})+|(?:[.,;:?%&#*("')!|+\-_~]|[$@]{3,})+$""")


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three letters follow each other in all texts: 28 ** 3 numbers."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for data, bounds, _ in byte_slices(batch.column(0)):
                # A blank between texts, so that none runs into the next.
                c = _CLASS[np.insert(data, bounds[1:-1], 32) if len(bounds) > 2 else data]
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = docs.select(text).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for row in rows:
        out[row["at"]] = row["n"]
    return out


class LetterModel:
    """Log probability of a letter after two others, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()


def _symbols(letter: str) -> list[int]:
    """As the letter model counts them: a letter beyond ASCII is several bytes."""
    if letter.isascii():
        return [int(_CLASS[ord(letter)])]
    return [OTHER] * len(letter.encode("utf-8", "replace"))


def _plain(letter: str) -> str:
    """The ASCII letter under a mark, if there is one."""
    base = unicodedata.normalize("NFD", letter)[0]
    return base if base != letter and "a" <= base <= "z" else ""


def decode(token: str, model: LetterModel, spaced: bool = False) -> str:
    """The likeliest reading of a token: a best path through the lattice of its characters.

    A sign is itself or a letter it may stand for, a letter with a mark may be the plain one, a
    run of three and more equal letters is one or two of them, two equal letters may be one, and in
    a text spelt with blanks (``spaced``) a blank may follow a letter.
    """
    lattice: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", token.lower()):
        letter, n = m[1], len(m[0])
        if n >= 3 and letter.isalpha():
            lattice.append([(letter, SINGLE_COST), (letter * 2, SINGLE_COST)])
        elif n == 2 and "a" <= letter <= "z":
            lattice.append([(letter * 2, 0.0), (letter, -LIKELIER)])
        else:
            one = [(letter, 0.0)] + [(x, SIGN_COST) for x in SIGNS.get(letter, "")]
            if plain := _plain(letter):  # nobody spells a word by accents
                one = [(letter, SIGN_COST if spaced else 0.0), (plain, 0.0 if spaced else SIGN_COST)]
            lattice += [one] * n
    log = model.log
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for edges in [*lattice, [(" ", 0.0)]]:
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, out) in best.items():
            for letters, cost in edges:
                ways = [(letters, cost), (" " + letters, cost + SPLIT_COST)] if spaced and out and letters != " " else [(letters, cost)]
                for path, price in ways:
                    x, y, s = a, b, score + price
                    for letter in path:
                        for c in _symbols(letter):
                            s += log[x][y][c]
                            x, y = y, c
                    if (x, y) not in step or step[x, y][0] < s:
                        step[x, y] = (s, out + path)
        best = step
    return max(best.values())[1].strip()


class Restorer:
    """Restores texts; readings of tokens are kept for the next text."""

    def __init__(self, counts: np.ndarray):
        model = LetterModel(counts)
        self.log = np.array(model.log)
        self.read = lru_cache(1 << 16)(lambda token, spaced: decode(token, model, spaced))
        self.word = lru_cache(1 << 16)(self._word)

    def text(self, words: list[str]) -> str:
        """Words of a text with the suspicious ones as they are read."""
        data, bounds = buffers(pa.array([" ".join(words)], pa.large_string()))
        return restored(Words(data, bounds, 0), self)[0].tobytes().decode()

    def spelt(self, letters: str) -> str:
        """A word or more of which each letter stood alone; one letter alone is not spelling."""
        return self.read(letters, True) if len(set(letters.lower())) > 1 else " ".join(letters)

    def _word(self, word: str) -> str:
        core = _EDGE.sub("", word)
        if re.fullmatch(r"[^\W_]([.\-_*~][^\W_]){2,}", core):
            return self.read(re.sub(r"[.\-_*~]", "", core), True)
        closed = self.closed(core)
        if suspicious(closed) or self.doubled(closed):
            return self.read(closed, False)
        return closed if closed != core else word

    def closed(self, word: str) -> str:
        """A word without the signs between letters that are likelier joined."""
        data = np.frombuffer(word.encode("utf-8", "replace"), np.uint8)
        gaps = _gaps(data, np.array([0, len(data)]), _JOINT)
        return np.delete(data, gaps[self.joined(data, gaps, len(data))]).tobytes().decode("utf-8", "replace")

    def joined(self, data: np.ndarray, gaps: np.ndarray, *edges) -> np.ndarray:
        """Which of the signs or blanks at ``gaps`` are likelier not there. Nothing is read over
        ``edges``, the ends of texts; a sign counts as a blank."""
        c = np.concatenate([_CLASS[data], [0, 0]])
        out = np.zeros(len(data) + 3, dtype=bool)  # bytes that are the first of a text
        out[[0, *edges]] = True
        a, b, x, y = c[gaps - 1], c[gaps + 1], np.where(out[gaps - 1], 0, c[gaps - 2]), np.where(out[gaps + 2], 0, c[gaps + 2])
        log = self.log
        return log[x, a, b] + log[a, b, y] - log[x, a, 0] - log[a, 0, b] - log[0, b, y] > LIKELIER

    def doubled(self, word: str) -> bool:
        """Whether a doubled letter of the word is likelier a single one."""
        data = np.frombuffer(word.encode("utf-8", "replace"), np.uint8)
        return bool(len(self.doubles(data, np.array([0, len(data)]))))

    def doubles(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The first letters of pairs of equal ones that are likelier one letter."""
        if len(data) < 2:
            return np.zeros(0, dtype=np.int64)
        c = np.concatenate([_CLASS[data], [0, 0]])
        first = np.zeros(len(data) + 2, dtype=bool)
        first[bounds] = True
        at = np.flatnonzero((c[:-3] == c[1:-2]) & _LETTER[data[:-1]] & ~first[1 : len(data)])
        x, l, y = np.where(first[at] | (at == 0), 0, c[at - 1]), c[at], np.where(first[at + 2], 0, c[at + 2])
        return at[self.log[x, l, y] - self.log[x, l, l] - self.log[l, l, y] > LIKELIER]


def suspicious(word: str) -> bool:
    letters = any(c.isascii() and c.isalpha() for c in word)
    return letters and (any(c in SIGNS for c in word) or re.search(r"([A-Za-z])\1\1", word) is not None)


def _gaps(data: np.ndarray, bounds: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Single bytes of a kind that stand between two ASCII letters of one text."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    letter = _LETTER[data]
    inside = between[data[1:-1]] & letter[:-2] & letter[2:]
    ends = bounds[(bounds > 0) & (bounds < len(data))]
    for at in (ends, ends - 1):  # the first and the last byte of a text are between nothing
        inside[at[(at > 0) & (at < len(data) - 1)] - 1] = False
    return np.flatnonzero(inside) + 1


def _suspicious_words(words: Words, restorer: Restorer) -> np.ndarray:
    """Words that may be obfuscated: letters with signs among them, or odd repetitions."""
    data = words.data

    def within(flags):
        total = np.zeros(len(flags) + 1, dtype=np.int32)
        np.cumsum(flags, out=total[1:])
        return total[words.end] - total[words.start]

    letter, leet = _LETTER[data], _SIGN[data]
    # A sign between a letter or sign and a letter or digit, or at an end of a word that has letters.
    inner = np.zeros(len(data), dtype=bool)
    inner[1:-1] = (leet | _JOINT[data])[1:-1] & (letter | leet)[:-2] & (letter | (data >= 48) & (data <= 57))[2:]
    folded = data | 32
    same = folded[1:] == folded[:-1]
    inner[2:] |= letter[2:] & same[1:] & same[:-1]
    inner[restorer.doubles(data, words.bounds)] = True
    odd = within(inner) > 0
    if len(words.start):
        last = data[words.end - 1]
        odd |= _SIGN[data[words.start]] | ((last >= 48) & (last <= 57)) | (last == 36)
        odd &= within(letter) > 0
    return odd


def _spelt_runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last word of each run of at least three single letters, of any alphabet of
    two bytes, or signs of a text."""
    n = len(words.start)
    single = np.zeros(n + 2, dtype=bool)
    if n:
        first = words.data[words.start]
        length = words.end - words.start
        single[1:-1] = ((length == 1) & (_LETTER[first] | _SIGN[first])) | ((length == 2) & (first >= 0xC3) & (first < 0xE0))
    new_text = np.ones(n + 1, dtype=bool)
    new_text[1:n] = words.text[1:] != words.text[:-1]
    begins = np.flatnonzero(single[1:] & (~single[:-1] | new_text))
    ends = np.flatnonzero(single[:-1] & (~single[1:] | new_text))
    ends = ends[: len(begins)] if len(ends) == len(begins) else ends[-len(begins) :]
    long = ends - begins >= 3
    return begins[long], ends[long]


def restored(words: Words, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts with what is obfuscated as it is read; all else as it was.

    First words spelt letter by letter, then what is odd inside a word, then pieces of words that
    are likelier joined.
    """
    runs = [(words.start[a], words.end[b - 1]) for a, b in zip(*_spelt_runs(words))]
    data, bounds = _replaced(words.data, words.bounds, runs, lambda old: restorer.spelt("".join(old.split())))
    if runs:
        words = Words(data, bounds, words.first)
    odd = np.flatnonzero(_suspicious_words(words, restorer))
    data, bounds = _replaced(data, bounds, list(zip(words.start[odd], words.end[odd])), restorer.word)
    gaps = _gaps(data, bounds, SPACE)
    gaps = gaps[restorer.joined(data, gaps, *bounds)]
    return np.delete(data, gaps), bounds - np.searchsorted(gaps, bounds)


def _replaced(data: np.ndarray, bounds: np.ndarray, spans: list, read) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds with each span, in order, as it is read."""
    parts, at, starts, grown = [], 0, [], []
    for start, end in spans:
        old = data[start:end].tobytes()
        new = read(old.decode("utf-8", "replace")).encode("utf-8", "replace")
        if new != old:
            parts += [data[at:start], np.frombuffer(new, np.uint8)]
            at = end
            starts.append(start)
            grown.append(len(new) - len(old))
    if not parts:
        return data, bounds
    shift = np.concatenate([[0], np.cumsum(grown)])[np.searchsorted(starts, bounds)]
    return np.concatenate([*parts, data[at:]]), bounds + shift


def restored_batches(texts, restorer: Restorer):
    """Words of the restored texts, slice by slice."""
    for words in word_slices(texts):
        data, bounds = restored(words, restorer)
        yield Words(data, bounds, words.first, NO_WORD)


def word_features(words: Words, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each word, its beginnings, and of those that come REPEATS times.

    With ``known`` (sorted) only these, as their places in it. Every pair is given once.
    """
    length = words.end - words.start
    level = np.uint64(3)
    bases = None if known is None else np.unique(known & ~level)
    likely = np.zeros(1 << 16, dtype=bool)  # a first look at the upper bits spares most searches
    if bases is not None:
        likely[bases >> np.uint64(48)] = True
    texts, features = [], []
    for k in (0, *PREFIXES):
        at = np.flatnonzero(length > k)
        end = words.end[at] if k == 0 else words.start[at] + k
        f = words.span_hash(words.start[at], end, k * 0x51ED27) & ~level
        if bases is not None:
            hit = np.flatnonzero(likely[f >> np.uint64(48)])
            hit = hit[_places(bases, f[hit]) >= 0]
            at, f = at[hit], f[hit]
        texts.append(words.text[at])
        features.append(f)
    text, feature = np.concatenate(texts), np.concatenate(features)
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    count = np.diff(np.append(np.flatnonzero(fresh), len(text)))
    text, feature = text[fresh], feature[fresh]
    often = [count >= n for n in REPEATS]
    text = np.concatenate([text, *(text[x] for x in often)])
    feature = np.concatenate([feature, *(feature[x] | np.uint64(i + 1) for i, x in enumerate(often))])
    if known is not None:
        place = _places(known, feature)
        text, feature = text[place >= 0], place[place >= 0].astype(np.uint64)
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def _places(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted array, -1 where it is missing."""
    if not len(known):
        return np.full(len(values), -1)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[place] == values, place, -1)


def fit_logistic(
    cells: tuple[np.ndarray, np.ndarray],
    features: int,
    labels: np.ndarray,
    times: np.ndarray,
    prior: float,
    lasso: float = 5e-3,
    ridge: float = 1e-6,
    steps: int = 400,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of different rows, each with its label and the times it came;
    ``cells`` are (row, feature) of all that rows hold, ``prior`` is the share of label 1 where
    the model is to be used.

    A first fit with an absolute penalty, in which both classes weigh the same, finds the
    features that are needed, so that words which only come along (in copies of a text, say)
    weigh nothing. A second fit weighs these, with the classes as frequent as ``prior`` says;
    without any feature its score is ``prior``.
    """
    one = labels == 1
    out, bias = np.zeros(features), 0.0
    row, column = cells
    kept = np.arange(features)
    for penalty, part in ((lasso, 0.5), (0.0, prior)):
        share = times * np.where(one, part / max(1, times[one].sum()), (1 - part) / max(1, times[~one].sum()))
        weight = out[kept]
        rate = 4.0 / (1 + share[row].sum() / 4)
        ahead, ahead_bias, speed = weight, bias, 1.0
        for _ in range(steps):
            total = np.bincount(row, weights=ahead[column], minlength=len(labels)) + ahead_bias
            error = (1 / (1 + np.exp(-np.clip(total, -50, 50))) - labels) * share
            slope = np.bincount(column, weights=error[row], minlength=len(kept))
            new = ahead - rate * (slope + (0.0 if penalty else ridge) * ahead)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0.0)
            new_bias = ahead_bias - rate * error.sum()
            faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
            pace = (speed - 1) / faster
            ahead, ahead_bias = new + pace * (new - weight), new_bias + pace * (new_bias - bias)
            weight, bias, speed = new, new_bias, faster
        out = np.zeros(features)
        out[kept] = weight
        held = np.abs(weight) > 1e-9
        inside = held[column]
        row, column, kept = row[inside], (np.cumsum(held) - 1)[column[inside]], kept[held]
    return out, float(bias)


class Model:
    """Letter counts, known features (sorted hashes), their weights and the intercept."""

    def __init__(self, counts, known, weights, bias):
        self.counts, self.known, self.weights, self.bias = counts, known, weights, bias


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, label 0 or 1; others are ignored, a label given twice counts twice).

    The letter model counts all texts of ``docs``. The classifier is fitted on at most
    ``sample_rows`` labelled rows of each class, the ones of the least hashes of their ids, and
    knows all words and beginnings of these that tell the classes apart by LEAST_Z standard errors.
    Only they and the sample's rows of them come to the driver; features that the fit gives no
    weight are not sent on. Without labels of both classes the score is the same for all texts.
    """
    importable(docs.sparkSession)
    counts = letter_counts(docs, text)
    known_labels = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    sizes = {row["y"]: row["n"] for row in known_labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        prior = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return Model(counts, np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    by_chance = known_labels.orderBy(F.xxhash64("_id"), "_id")
    chosen = by_chance.where("y = 1").limit(sample_rows).unionByName(by_chance.where("y = 0").limit(sample_rows))
    # At most 2 * sample_rows ids and labels are broadcast, whatever the size of the tables.
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "y").checkpoint()

    def found(batches):
        restorer = Restorer(counts)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for words in restored_batches(batch.column(0), restorer):
                of, feature = word_features(words)
                values, at = np.unique(feature, return_inverse=True)
                one = np.bincount(at, weights=y[words.first + of], minlength=len(values)).astype(np.int64)
                every = np.bincount(at, minlength=len(values))
                columns = [pa.array(values.view(np.int64)), pa.array(one), pa.array(every - one)]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "one", "none"])

    seen = sample.mapInArrow(found, "feature long, one long, none long").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("none").alias("none"))
    taken = {row["y"]: row["n"] for row in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    a, b = max(1, taken.get(1, 0)), max(1, taken.get(0, 0))
    p = (F.col("one") + F.col("none")) / (a + b)
    gap = F.abs(F.col("one") / a - F.col("none") / b) / F.sqrt(p * (1 - p) * (1 / a + 1 / b) + 1e-12)
    telling = seen.where(F.col("one") + F.col("none") >= LEAST_DOCS).withColumn("gap", gap).where(F.col("gap") >= LEAST_Z)
    best = telling.select("feature").collect()
    known = np.sort(np.array([row["feature"] for row in best], dtype=np.int64).view(np.uint64))

    def rows_of(batches):
        restorer = Restorer(counts)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for words in restored_batches(batch.column(0), restorer):
                of, feature = word_features(words, known)
                cut = np.searchsorted(of, np.arange(len(words.count) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[words.first : words.first + len(words.count)], pa.int32()),
                     pa.array([feature[i:j].astype(np.int32).tolist() for i, j in zip(cut[:-1], cut[1:])], pa.list_(pa.int32()))],
                    names=["y", "at"],
                )

    rows = sample.mapInArrow(rows_of, "y int, at array<int>").groupBy("y", "at").agg(F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["y"], r["at"]))
    held = [len(row["at"]) for row in rows]
    cells = np.repeat(np.arange(len(rows)), held), np.array([at for row in rows for at in row["at"]], dtype=np.int64)
    y, times = (np.array([row[c] for row in rows], dtype=np.float64) for c in ("y", "n"))
    weights, bias = fit_logistic(cells, len(known), y, times, sizes[1] / sum(sizes.values()))
    return Model(counts, known[weights != 0], weights[weights != 0], bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score``, the probability of label 1 (0 to 1); only the text is read.

    A null text scores as the empty one, which has no features and gets the intercept's
    probability. Rows stay as they are; a ``score`` column of ``docs`` is replaced.
    """
    importable(docs.sparkSession)
    docs = docs.drop("score")
    at = docs.columns.index(text)
    counts, known, weights, bias = model.counts, model.known, model.weights, model.bias

    def run(batches):
        restorer = Restorer(counts)
        for batch in batches:
            out = []
            for words in restored_batches(batch.column(at), restorer):
                of, feature = word_features(words, known)
                total = np.bincount(of, weights=weights[feature.astype(np.int64)] if len(of) else None, minlength=len(words.count)) + bias
                out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            column = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("score")).schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo FOLDS; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def trained(spark: SparkSession, sf: str, docs: DataFrame) -> Model:
    """Fitted on the labels that are not held out."""
    from areagrade.sources.tables import read_table

    labels = read_table(spark, sf, "labels").select("doc_id", "toxic")
    return fit(docs, labels.where(fold(F.col("doc_id")) != 0))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, sf, docs))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
