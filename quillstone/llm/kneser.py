"""Quality rules: fixed counts, and perplexity under a modified Kneser-Ney model with bands per language.

The model is one of characters, of `order` at a time, that runs on across words: a text is its lower-cased words with
one space between them. Spark counts the n-grams of the highest order over all documents; lower orders hold continuation
counts, and every order has three discounts from its counts of counts. All n-grams are kept. Their probabilities are
read in sorted hash arrays of at most about `block_entries`, one broadcast after another: a document's logarithms add
up over the blocks, so the model may grow with the corpus while what an executor holds does not.
A document is rejected if its log perplexity a character lies outside its language's band for texts of its length
(lengths between the same powers of two): `reach` deviations below or above the median of the documents that pass the
fixed rules (of equal perplexities, one), the deviation taken from the quartiles on that side. A length with fewer than
`least_docs` such documents takes the band of the whole language, twice as wide; a language with fewer has none.

Null texts have no words and fail the word minimum. A null lang is a language of its own. Texts of equal content get
equal figures, wherever they lie. Empty tables give no rows. No text is cut; a worker holds a chunk at a time, and works
on about a million characters of it at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrays import chunks, covered, inside, mix, rolling, string_hashes, texts, words
from quillstone.llm.shared import release, stored

NO_LANG = ""
BEGIN, END = 2, 3
SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], np.uint8)
#: Characters that are worked on at once, and n-grams that a worker gathers before it hands them on.
BLOCK, GATHERED = 1 << 20, 1 << 20


@dataclass(frozen=True)
class QualityRules:
    """order: characters of an n-gram. block_entries: n-grams of a broadcast. reach: of a band, in deviations."""

    order: int = 5
    block_entries: int = 1 << 22
    reach: float = 7.0
    least_docs: int = 20
    min_words: int = 20
    repeat_percent: int = 30
    repeat_window: int = 8


def padded(values: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings, each with order - 1 BEGIN before and END after; and each string's length so."""
    values = values.to_pylist()
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, values), np.int64, len(values))
    size = n + order
    out = np.full(int(size.sum()), BEGIN, np.uint32)
    ends = np.cumsum(size)
    out[ends - 1] = END
    at = np.repeat(ends - size + order - 1 - (np.cumsum(n) - n), n) + np.arange(len(points))
    out[at] = points
    return out, size


def gram_hashes(points: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """Hash of the n symbols that end at each position (the first n - 1 positions are not meaningful)."""
    points = points.astype(np.uint64)
    out = np.full(len(points), np.uint64(n), np.uint64)
    for back in range(n - 1, -1, -1):
        shifted = points if not back else np.concatenate([np.zeros(back, np.uint64), points[:-back]])
        out = out * np.uint64(0x9E3779B97F4A7C15) + shifted
    return mix(out ^ seed)


def lang_seed(lang: str) -> np.uint64:
    return string_hashes(pa.array([lang]), 5)[0]


def sequences(part: pa.RecordBatch, order: int) -> Iterator[tuple]:
    """For each language of a chunk: its name, the rows, their symbols one after another, and how many each has.
    Texts without words are left out."""
    langs = pc.fill_null(part.column("lang").cast(pa.string()), NO_LANG)
    for lang in pc.unique(langs).to_pylist():
        at = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
        flat, offsets = words(pc.utf8_lower(texts(part.column("text").take(pa.array(at)))))
        full = np.diff(offsets) > 0
        if full.any():
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            joined = pc.binary_join(lists, " ").filter(pa.array(full))
            yield lang, at[full], *padded(joined, order)


def blocks(points: np.ndarray, size: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the symbols, of BLOCK positions after the order - 1 before them: symbols, the positions in the piece that
    the model predicts (characters and END), and the text of each."""
    ends = np.cumsum(size)
    for lo in range(0, len(points), BLOCK):
        before = min(lo, order - 1)
        piece = points[lo - before : lo + BLOCK]
        position = np.arange(lo, min(lo + BLOCK, len(points)))
        text = np.searchsorted(ends, position, side="right")
        ok = position - (ends[text] - size[text]) >= order - 1
        yield piece, np.flatnonzero(ok) + before, text[ok]


def distinct_grams(piece: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, symbols (n x order) and counts of the distinct n-grams that end at the given positions."""
    hashed = gram_hashes(piece, order, np.uint64(0))[at]
    one, begin, own = runs_of(hashed)
    return own, piece[at[one][:, None] + np.arange(1 - order, 1)], np.diff(begin)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct value, in ascending order: a place of it, where its run in the sorted order begins (and the end of
    the last run), and the value."""
    order = np.argsort(values)
    held = values[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(held)), bool), held[1:] != held[:-1]]))
    return order[begin], np.append(begin, len(held)), held[begin]


def _merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    hashed, grid, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(hashed)
    one, begin, own = runs_of(hashed)
    return own, grid[one], np.add.reduceat(n[order], begin[:-1]) if len(own) else n


def gram_counts(docs: DataFrame, p: QualityRules) -> DataFrame:
    """lang, gram, n over all documents; summed in each worker and each partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}

        def out(lang: str) -> pa.RecordBatch:
            _, grid, n = _merged(held.pop(lang))
            raw = grid.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            grams = [raw[i : i + p.order] for i in range(0, len(raw), p.order)]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for part in chunks(batches, "text"):
            for lang, _, points, size in sequences(part, p.order):
                own = held.setdefault(lang, [])
                own += [distinct_grams(piece, at, p.order) for piece, at, _ in blocks(points, size, p.order) if len(at)]
                held[lang] = own = [_merged(own)]
                if len(own[0][0]) > GATHERED:
                    yield out(lang)
        for lang in list(held):
            yield out(lang)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashArray:
    """Sorted hashes with values; lookup by an index on the leading bits, then a step or two along the array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.bits = np.uint64(64 - max(4, int(len(keys)).bit_length()))
        leading = (self.keys >> self.bits).astype(np.int64)
        self.begin = np.searchsorted(leading, np.arange((1 << (64 - int(self.bits))) + 1)).astype(np.int32)

    def get(self, wanted: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(wanted), default, np.float32)
        leading = (wanted >> self.bits).astype(np.int64)
        at, end = self.begin[leading], self.begin[leading + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            same = self.keys[here] == wanted[todo]
            out[todo[same]] = self.values[here[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


def rule_counts(column: pa.Array, p: QualityRules) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    column = texts(column)
    flat, offsets = words(column)
    doc = np.repeat(np.arange(len(column)), np.diff(offsets))
    chars = np.bincount(doc, weights=pc.utf8_length(flat).to_numpy(zero_copy_only=False), minlength=len(column)).astype(np.int64)
    symbols = np.zeros(len(column), np.int64)
    for c in map(chr, SYMBOLS):
        symbols += pc.count_substring(column, c).to_numpy(zero_copy_only=False)
    lines = []
    for text in column.to_pylist():
        seen = Counter(text.split("\n"))
        lines.append(sum(n - 1 for line, n in seen.items() if n > 1 and line.strip(" \t\n\x0b\x0c\r")))
    k = p.repeat_window
    at = np.flatnonzero(inside(offsets, k, len(flat)))
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.uint64)
    runs = rolling(mix(codes), k)[at]
    own = mix(runs ^ mix(doc[at].astype(np.uint64)))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = np.bincount(doc, weights=covered(at[twice], k, len(flat)), minlength=len(column)).astype(np.int64)
    return np.diff(offsets), chars, symbols, np.array(lines, np.int64), repeated


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: of counts 1, 2, and 3 or more, from how many n-grams have counts 1 to 4 (Chen and Goodman, 1999)."""
    few = level.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)])
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    usual = (F.col("c1") > 0) & (F.col("c2") > 0)

    def one(k: int, otherwise: float):
        raw = F.when(F.col(f"c{k}") > 0, k - (k + 1) * y * F.col(f"c{k + 1}") / F.nullif(F.col(f"c{k}"), F.lit(0.0))).otherwise(k * y)
        return F.when(usual, F.least(F.greatest(raw, F.lit(0.05)), F.lit(k - 0.05))).otherwise(otherwise).alias(f"d{k}")

    return few.select("lang", one(1, 0.5), one(2, 0.75), one(3, 0.9))


def gram_probabilities(level: DataFrame, p: QualityRules) -> DataFrame:
    """lang, gram, n of the highest order -> lang, gram, p: interpolated probabilities, from the lowest order up."""
    levels = {p.order: level}
    for n in range(p.order - 1, 0, -1):
        levels[n] = stored(levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n")), "level")
    known = levels[1].groupBy("lang").agg(F.count("*").alias("size")).select("lang", F.lit("").alias("gram"), (1 / (F.col("size") + 1)).alias("p"))
    for n in range(1, p.order + 1):
        cut = _discounts(levels[n])
        rows = levels[n].withColumns({"context": F.substring("gram", 1, n - 1), "suffix": F.substring("gram", 2, n - 1)})
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") > 2).alias("n3"))
        weight = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")
        sums = sums.join(cut, "lang").withColumn("weight", weight).drop("n1", "n2", "n3")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        lower = known.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        known = rows.join(sums, ["lang", "context"]).join(lower, ["lang", "suffix"]).select("lang", "gram", ((F.col("n") - less) / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))
    return known


def model_blocks(known: DataFrame, p: QualityRules) -> Iterator[HashArray]:
    """The model (lang, gram, p) in sorted hash arrays, each of about p.block_entries: n-gram to log probability. Only one
    at a time is on the driver. There is at least one, if an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            seeds = np.array([lang_seed(x) for x in lang.dictionary.to_pylist()], np.uint64)[lang.indices.to_numpy()]
            raw = "".join(batch.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass")
            keys = gram_hashes(np.frombuffer(raw, np.uint32), p.order, np.uint64(0))[p.order - 1 :: p.order]
            yield pa.RecordBatch.from_arrays([pa.array(mix(keys ^ seeds).view(np.int64)), batch.column("log_p")], ["key", "log_p"])

    count = max(1, -(-known.count() // p.block_entries))
    rows = known.select("lang", "gram", F.log(F.greatest("p", F.lit(1e-12))).cast("float").alias("log_p"))
    for i in range(count):
        own = rows.filter(F.pmod(F.xxhash64("lang", "gram"), F.lit(count)) == i)
        t = own.mapInArrow(run, "key long, log_p float").toArrow()
        yield HashArray(t["key"].to_numpy().view(np.uint64), t["log_p"].to_numpy())


def log_probability(part: pa.RecordBatch, model: HashArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the sum of its n-grams' logarithms that the block has, and the number of all its n-grams."""
    total, count = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
    for lang, rows, points, size in sequences(part, order):
        count[rows], seed = size - order + 1, lang_seed(lang)
        for piece, at, text in blocks(points, size, order):
            hashed, inverse = np.unique(gram_hashes(piece, order, np.uint64(0))[at], return_inverse=True)
            logs = model.get(mix(hashed ^ seed), 0.0)[inverse]
            total[rows] += np.bincount(text, weights=logs, minlength=len(rows))
    return total, count


COUNTED = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COLUMNS) + ", n_symbols_scored long, log_p double"


def measured(docs: DataFrame, p: QualityRules) -> DataFrame:
    """doc_id, lang, the fixed counts, and log_perplexity (per character; null without words)."""
    level = stored(gram_counts(docs, p), "grams")
    known = stored(gram_probabilities(level, p), "probabilities")
    release(level)
    model = map(docs.sparkSession.sparkContext.broadcast, model_blocks(known, p))
    held, following = next(model), next(model, None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", F.lit(0.0).alias("log_p"))

    def added(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, "text"):
                total, _ = log_probability(part, held.value, p.order)
                yield part.set_column(3, "log_p", pa.array(part.column("log_p").to_numpy() + total))

        return run

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            total, count = log_probability(part, held.value, p.order)
            counts = map(pa.array, rule_counts(part.column("text"), p))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *counts, pa.array(count), pa.array(part.column("log_p").to_numpy() + total)], [f.split()[0] for f in COUNTED.split(", ")])

    while following is not None:  # stored in between, so that a worker holds one block
        rows = stored(rows.mapInArrow(added(held), rows.schema), "summed", compression="zstd")
        held.destroy()
        held, following = following, next(model, None)
    scored = rows.mapInArrow(last, COUNTED)
    return scored.withColumn("log_perplexity", F.round(-F.col("log_p") / F.nullif("n_symbols_scored", F.lit(0)), 6)).drop("log_p")


def bands(passed: DataFrame, p: QualityRules, *by: str) -> DataFrame:
    """The columns by, lower, upper: of rows of log_perplexity, where there are enough of them."""
    q = passed.groupBy(*by).agg(F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000).alias("q"), F.count("*").alias("n")).filter(F.col("n") >= p.least_docs)
    # 0.6745: quartile of a normal distribution, in deviations. 1e-3: for texts that are all alike.
    side = lambda a, b: F.greatest((F.col("q")[b] - F.col("q")[a]) / 0.6745, F.lit(1e-3))
    return q.select(*by, F.col("q")[1].alias("middle"), side(0, 1).alias("below"), side(1, 2).alias("above"))


def judge_quality(docs: DataFrame, p: QualityRules | None = None) -> DataFrame:
    """doc_id, lang, text -> a row per document: the counts, base_failed, log_perplexity, lower, upper, kept."""
    p = p or QualityRules()
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.repeat_percent * F.col("n_words"))
    rows = stored(measured(docs, p).withColumn("base_failed", failed).withColumns({"language": F.coalesce("lang", F.lit(NO_LANG)), "octave": F.floor(F.log2(F.greatest("n_symbols_scored", F.lit(1)))).cast("int")}), "measured")
    # Copies count once, so that no group of them makes a band of its own.
    passed = rows.filter(~F.col("base_failed")).select("language", "octave", "log_perplexity").distinct()
    exact, whole = bands(passed, p, "language", "octave"), bands(passed, p, "language")
    wide = whole.select("language", *(F.col(c).alias(f"all_{c}") for c in ("middle", "below", "above")))
    # As many rows as languages times octaves; broadcast if that was counted to be few, else joined by shuffling.
    known = stored(passed.select("language", "octave").distinct().join(wide, "language").join(exact, ["language", "octave"], "left"), "bands")
    edges = known.select("language", "octave", (F.coalesce("middle", "all_middle") - p.reach * F.coalesce("below", 2 * F.col("all_below"))).alias("lower"), (F.coalesce("middle", "all_middle") + p.reach * F.coalesce("above", 2 * F.col("all_above"))).alias("upper"))
    rows = rows.join(F.broadcast(edges) if edges.count() <= 10_000 else edges, ["language", "octave"], "left")
    ok = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return rows.select("doc_id", *COLUMNS, "base_failed", (~F.col("base_failed") & ok).alias("kept"), "log_perplexity", "lower", "upper")
