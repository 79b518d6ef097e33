"""LM scoring: prediction by partial matching over the bytes of whole texts.

A text is coded byte by byte as its lower-cased words, a blank behind each, and one end. The
contexts of a byte are the ORDER bytes before it, across blanks, and fewer; ends stand in for the
bytes before a text. The context trie is pretrained on all training texts. In a context, each byte
that was seen gives up DISCOUNT of its count to the escape; a byte that was not seen costs the
escape and is looked for in the next shorter context, with all bytes of the longer one excluded.

Equal (context, byte) pairs cost the same wherever they stand, so each is scored once. Pairs are
dealt by the DEALT bytes next before the byte: all contexts that end alike, and so all from DEALT
bytes on that a byte escapes to, lie in one partition, at most 2**24 pairs of them. The shorter
contexts are at most 2**24 more counts, which every task is sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.llm.wordhash import _LOWER, SPACE, Words, word_slices
from areagrade.llm.workers import importable

ORDER = 5  # with the byte itself, 48 bits of an id
DEALT = 3
DISCOUNT = 0.4
FREQUENT = 1 << 20  # tokens and pairs that tasks look up themselves; all others are joined
END = 0x0B  # the end of a text, as a token and as a byte; no word holds white space
HELD = 1 << 21  # counts that a task merges before they are shuffled
FLUSH = 1 << 18  # pairs that are scored together
WINDOW = 1 << 20  # bytes of texts that are looked at together
FOLDS, HELD_OUT = 5, 1
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo FOLDS is HELD_OUT; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == HELD_OUT


def token_ids(words: Words) -> np.ndarray:
    """Negative numbers for tokens; (context, byte) pairs are positive."""
    return (words.hash | np.uint64(1 << 63)).view(np.int64)


END_ID = int(token_ids(Words(np.array([END], np.uint8), np.array([0, 1]), 0, np.zeros(256, dtype=bool)))[0])


def coded(words: Words):
    """(text of each byte, id of each byte with its context) of the texts, WINDOW bytes at a time.

    The byte itself is the lowest of an id, the byte before it the highest.
    """
    size = words.end - words.start
    total = np.concatenate([[0], np.cumsum(size)])
    length = total[words.offset[1:]] - total[words.offset[:-1]] + words.count + ORDER + 1
    bounds = np.concatenate([[0], np.cumsum(length)])
    inside = np.flatnonzero(~SPACE[words.data])
    place = np.arange(len(inside)) + np.repeat(np.arange(len(size)) + words.text * (ORDER + 1) + ORDER, size)
    data = np.full(bounds[-1], 32, np.uint8)
    data[place] = _LOWER[words.data[inside]]
    before = (bounds[:-1, None] + np.arange(ORDER)).ravel()
    data[before] = END
    data[bounds[1:] - 1] = END
    real = np.ones(len(data), dtype=bool)
    real[before] = False
    text = np.repeat(np.arange(len(length)), length)
    for low in range(0, len(data), WINDOW):
        window = data[max(0, low - ORDER) : low + WINDOW].astype(np.int64)
        ids = window.copy()
        for j in range(1, ORDER + 1):
            ids[j:] |= window[:-j] << (8 * (ORDER + 1 - j))
        chosen = real[low : low + WINDOW]
        yield text[low : low + WINDOW][chosen], ids[min(low, ORDER) :][chosen]


def _summed(ids: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """Each id once, in order, with the sums of its weights."""
    values, place = np.unique(ids, return_inverse=True)
    return [values, *(np.bincount(place, weights=w, minlength=len(values)).astype(np.int64) for w in weights)]


def _batch(*columns: np.ndarray, names: tuple[str, ...] = ("id", "n", "total")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))


def counted(docs: DataFrame, text: str, training: Column, most: int = HELD) -> DataFrame:
    """(id, n, total): how often each token and each (context, byte) comes in training texts and in all.

    Sorted by id; pairs that share their context's last DEALT bytes are in one partition. Written
    with ``checkpoint``, which keeps both. A task holds no more than about ``most`` counts.
    """

    def count(batches):
        held, size = [], 0
        for batch in batches:
            trains = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=np.int64)
            for words in word_slices(batch.column(0), size=WINDOW):
                train = trains[words.first : words.first + len(words.count)]
                held.append([np.array([END_ID]), np.array([train.sum()]), np.array([len(train)])])
                held.append(_summed(token_ids(words), train[words.text], np.ones(len(words.text))))
                size += len(held[-1][0])
                for of, ids in coded(words):
                    held.append(_summed(ids, train[of], np.ones(len(of))))
                    size += len(held[-1][0])
                    if size >= most:
                        merged = _summed(*(np.concatenate(c) for c in zip(*held)))
                        held, size = [merged], len(merged[0])
                        if size >= most // 2:
                            yield _batch(*merged)
                            held, size = [], 0
        if held:
            yield _batch(*_summed(*(np.concatenate(c) for c in zip(*held))))

    def merge(batches):
        """Sorted rows with each id once; the last one waits for the next batch."""
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            columns = [np.concatenate([kept, batch.column(i).to_numpy()]) for i, kept in enumerate(last)]
            if not len(columns[0]):
                continue
            first = np.flatnonzero(np.diff(columns[0], prepend=columns[0][0] - 1))
            columns = [columns[0][first], *(np.add.reduceat(c, first) for c in columns[1:])]
            last = [c[-1:] for c in columns]
            yield _batch(*(c[:-1] for c in columns))
        yield _batch(*last)

    schema = "id long, n long, total long"
    plain = docs.select(F.col(text).alias("text"), training.alias("training"))
    home = F.when(F.col("id") < 0, F.col("id")).otherwise(F.shiftright("id", 8 * (ORDER + 1 - DEALT)))
    return plain.mapInArrow(count, schema).repartition(home).sortWithinPartitions("id").mapInArrow(merge, schema).checkpoint()


def find(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted array, -1 where it is missing."""
    if not len(known):
        return np.full(len(values), -1)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[place] == values, place, -1)


def shorter(ids: np.ndarray) -> np.ndarray:
    """Ids in the context without its first byte."""
    return ((ids >> 16) << 8) | (ids & 255)


class Level:
    """The contexts of one length: their ids with counts, and totals by context.

    ``covered`` of a context is what its bytes have together in the next shorter one: with these
    excluded, the shorter context has its total less that.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, below: Level | None):
        self.ids, self.counts = ids, counts.astype(np.float64)
        self.contexts, first = np.unique(ids >> 8, return_index=True)
        per_context = lambda values: np.add.reduceat(values, first) if len(first) else np.zeros(0)
        self.totals = per_context(self.counts)
        self.kinds = np.diff(np.append(first, len(ids))).astype(np.float64)
        self.covered = per_context(below.counts[find(below.ids, shorter(ids))]) if below else np.zeros(len(first))


def levels(ids: np.ndarray, counts: np.ndarray, most: int, least: int = 0, below: Level | None = None) -> list[Level]:
    """The levels of ``least`` to ``most`` context bytes, from counts of the longest."""
    tables = [(ids, counts)]
    for _ in range(most - least):
        tables.append(_summed(shorter(tables[-1][0]), tables[-1][1]))
    out = []
    for table in reversed(tables):
        below = Level(*table, below)
        out.append(below)
    return out


def log10_of(ids: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 probability of each byte in its context of ORDER bytes."""
    n = len(ids)
    out, excluded, gone = np.zeros(n), np.zeros(n), np.zeros(n)  # occurrences and kinds of bytes that longer contexts hold
    left = np.arange(n)
    for level in reversed(trie):
        place = find(level.contexts, ids >> 8)
        known = place >= 0
        at, place = left[known], place[known]
        total, kinds = level.totals[place] - excluded[at], level.kinds[place] - gone[at]
        own = find(level.ids, ids[known])
        hit = own >= 0
        out[at[hit]] += np.log10((level.counts[own[hit]] - DISCOUNT) / total[hit])
        miss = ~hit & (kinds > 0)
        out[at[miss]] += np.log10(DISCOUNT * kinds[miss] / total[miss])
        excluded[at], gone[at] = level.covered[place], level.kinds[place]
        stays = ~known
        stays[known] = ~hit
        left, ids = left[stays], shorter(ids[stays])
    out[left] -= np.log10(np.maximum(256 - gone[left], 1))
    return out


def most_frequent(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """The rows of at least the weight that as few as ``most`` rows have: a proven bound, without a sort.

    Counts of classes of weights (five to each doubling) tell the limit.
    """
    level = F.floor(F.log2(F.col(weight)) * 5).cast("int")
    classes = rows.where(F.col(weight) > 0).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min(weight).alias("least"))
    limit, taken = 1, 0
    for row in sorted(classes.collect(), key=lambda r: -r["level"]):
        if taken + row["n"] > most:
            break
        taken, limit = taken + row["n"], row["least"]
    else:
        return rows.where(F.col(weight) > 0)
    return rows.where(F.col(weight) >= limit) if taken else rows.where(F.lit(False))


def _driver_arrays(rows: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a frame of proven size, sorted by the first."""
    table = rows.select(*names).toArrow()
    order = np.argsort(table.column(names[0]).to_numpy())
    return [table.column(n).to_numpy()[order] for n in names]


def short_contexts(counts: DataFrame) -> DataFrame:
    """(id, n) of all contexts of DEALT - 1 bytes in training texts: at most 256**DEALT rows."""
    own = F.expr(f"shiftleft(shiftright(id, {8 * (ORDER + 2 - DEALT)}), 8) | (id & 255)")
    return counts.where("id >= 0 and n > 0").groupBy(own.alias("id")).agg(F.sum("n").alias("n"))


def valued(counts: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(id, total, value) of ``counted`` rows: log10 of the probability of a pair; a token's count in training texts."""
    low_ids, low_counts = _driver_arrays(short_contexts(counts), "id", "n")

    def run(batches):
        low = levels(low_ids, low_counts, DEALT - 1)

        def scored(ids, n, total):
            value = n.astype(np.float64)
            pair, seen = ids >= 0, (ids >= 0) & (n > 0)
            value[pair] = log10_of(ids[pair], low + levels(ids[seen], n[seen], ORDER, DEALT, low[-1]))
            return _batch(ids, total, value, names=("id", "total", "value"))

        held, size, enough = [], 0, flush
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
            if size >= enough:
                rows = [np.concatenate(c) for c in zip(*held)]
                home = rows[0] >> (8 * (ORDER + 1 - DEALT))
                cut = int(np.searchsorted(home, home[-1]))  # the last contexts may go on in the next batch
                if cut:
                    yield scored(*(c[:cut] for c in rows))
                held, size = [[c[cut:] for c in rows]], len(home) - cut
                enough = max(flush, 2 * size)
        if size:
            yield scored(*(np.concatenate(c) for c in zip(*held)))

    return counts.mapInArrow(run, "id long, total long, value double")


def score_texts(docs: DataFrame, text: str, training: Column, kept: list[str], frequent: int = FREQUENT, held: int = HELD, flush: int = FLUSH) -> DataFrame:
    """``kept`` columns with n_tokens, n_known, train_tokens, base_score and score of each row.

    Learns from the rows where ``training`` is true; ``base_score`` is that of single tokens with
    half a count added, ``score`` the trie's log10 probability of the text. The FREQUENT tokens and
    pairs go to the tasks as a table of bounded size, and all others are joined by their
    id, so neither a common one nor a large vocabulary meets one task. A null text is the
    empty one: an end, and nothing else. Repeated rows and ids count each; without training rows
    every byte is equally likely; an empty table gives no rows. Kept columns with one of the added
    names are replaced, all others may have any name. Tokens are told apart by 63 bits of a hash.
    """
    spark = docs.sparkSession
    importable(spark)
    wanted = {f"kept{i}": c for i, c in enumerate(kept) if c.lower() not in ADDED}
    own_columns = [F.col(c).alias(k) for k, c in wanted.items()]
    counts = counted(docs, text, training, held)
    sums = counts.where("id < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds")).first()
    all_tokens, divisor = sums["n"], float(np.log10(sums["n"] + 0.5 * (sums["kinds"] + 1)))
    ends = counts.where(F.col("id") == END_ID).first()
    end_n = ends["n"] if ends else 0
    values = valued(counts, flush).checkpoint()
    known, known_value = _driver_arrays(most_frequent(values, "total", frequent), "id", "value")

    def score(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for words in word_slices(batch.column(0), size=WINDOW):
                m = len(words.count)
                add = lambda of, weights: np.bincount(of, weights=weights, minlength=m).astype(np.float64)  # noqa: E731, B023
                ids = token_ids(words)
                place = find(known, ids)
                hit = place >= 0
                n = known_value[place[hit]]
                seen, base = add(words.text[hit], n > 0), add(words.text[hit], np.log10(n + 0.5))
                log, missed = np.zeros(m), [(words.text[~hit], ids[~hit])]
                for of, ids in coded(words):
                    different, which = np.unique(ids, return_inverse=True)
                    place = find(known, different)
                    own = known_value[place] if len(known) else np.zeros(len(place))
                    log += add(of, np.where(place >= 0, own, 0.0)[which])
                    miss = (place < 0)[which]
                    missed.append((of[miss], ids[miss]))
                rest_of, rest = (np.concatenate(c) for c in zip(*missed))
                order = np.lexsort((rest, rest_of))
                rest_of, rest = rest_of[order], rest[order]
                fresh = np.ones(len(rest), dtype=bool)
                fresh[1:] = (rest[1:] != rest[:-1]) | (rest_of[1:] != rest_of[:-1])
                first = np.flatnonzero(fresh)
                times = np.diff(np.append(first, len(rest)))
                cut = np.searchsorted(rest_of[first], np.arange(m + 1)).astype(np.int32)
                columns = {
                    "row": pa.array(row + words.first + np.arange(m)),
                    "tokens": pa.array(words.count + 1),
                    "seen": pa.array(seen.astype(np.int64)),
                    "base": pa.array(base),
                    "log": pa.array(log),
                    "rest": pa.ListArray.from_arrays(pa.array(cut), pa.array(rest[first])),
                    "times": pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32))),
                }
                own = batch.slice(words.first, m)
                arrays = [own.column(i + 1) for i in range(len(wanted))] + list(columns.values())
                yield pa.RecordBatch.from_arrays(arrays, names=[*wanted, *columns])
            row += batch.num_rows

    plain = docs.select(F.col(text).alias("_text"), *own_columns)
    schema = plain.drop("_text").withColumns({"row": F.lit(0).cast("long"), "tokens": F.lit(0).cast("long"), "seen": F.lit(0).cast("long"), "base": F.lit(0.0), "log": F.lit(0.0)})
    schema = schema.withColumns({"rest": F.array(F.lit(0).cast("long")), "times": F.array(F.lit(0).cast("int"))}).schema
    rows = plain.mapInArrow(score, schema).checkpoint()
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("id"), F.col("r.times").alias("times"))
    token = F.col("id") < 0
    joined = (
        rest.join(values.select("id", "value"), "id")
        .groupBy("row")
        .agg(
            F.sum(F.when(token & (F.col("value") > 0), F.col("times"))).alias("seen1"),
            F.sum(F.when(token, F.col("times") * F.log10(F.col("value") + 0.5))).alias("base1"),
            F.sum(F.when(~token, F.col("times") * F.col("value"))).alias("log1"),
        )
    )
    zero = F.lit(0.0)
    return rows.join(joined, "row", "left").select(
        *(F.col(k).alias(c) for k, c in wanted.items()),
        F.col("tokens").alias("n_tokens"),
        (F.col("seen") + F.coalesce("seen1", F.lit(0)) + int(end_n > 0)).cast("long").alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base1", zero) + float(np.log10(end_n + 0.5)) - F.col("tokens") * divisor).alias("base_score"),
        (F.col("log") + F.coalesce("log1", zero)).alias("score"),
    )


def op5_ppm(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = read_table(spark, sf, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = score_texts(docs, "text", ~F.col("held_out"), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
