"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases.

The lexicon is learnt: word stems and words that labelled toxic documents have and others lack. Folding maps look-alike
letters and digits to letters, so that disguised spellings match too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, restored

#: bound of the labelled rows that the lexicon is fitted on: those of smallest key hash
FIT_ROWS = 20_000
#: an entry stands in this share of the toxic rows (and in MIN_ROWS), and is so many times as frequent there
MIN_SHARE, MIN_ROWS, MIN_RATIO = 0.015, 4, 20.0
STEMS = range(4, 8)

# Letters that look like Latin ones, and digits and signs in their place.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "idiot proof")


class Folding(dict):
    """For str.translate: lower-cased look-alikes to Latin letters, what is no letter to a space; grows by the characters met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = "".join(LOOKALIKES.get(x, x) for x in c.lower())
        self[code] = low if low.isalpha() else " "
        return self[code]


FOLDING = Folding()


def fold(text: str) -> str:
    """Folded words, with a space before, between and after them (more than one where signs stood)."""
    return f" {text.translate(FOLDING)} "


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Lexicon:
    """Patterns (' word ' or ' stem') with weights, exception phrases, and the density that scores 0.5."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    middle: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p.rstrip()), w))
        a.make_automaton()
        return a

    def density(self, text: str, automaton) -> float:
        """The weights of all matches outside exception phrases, by the square root of the number of words."""
        folded = fold(text)
        total, spans = 0.0, None
        for end, (size, w) in automaton.iter(folded):
            if spans is None:
                spans = self.exempt(folded)
            start = end - size + (1 if folded[end] != " " else 0)
            if not any(lo <= start < hi for lo, hi in spans):
                total += w
        return total / math.sqrt(max(1, len(folded.split()))) if total else 0.0

    def exempt(self, folded: str) -> list[tuple[int, int]]:
        out = []
        for p in self.exceptions:
            at = folded.find(f" {p} ")
            while at >= 0:
                out.append((at, at + len(p) + 1))
                at = folded.find(f" {p} ", at + 1)
        return out

    def score(self, density: float) -> float:
        return density / (density + self.middle)


def row_terms(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


def pick_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries with their weights: of nested stems the longest that keeps (nearly) all rows of the shortest."""
    need = max(MIN_ROWS, MIN_SHARE * toxic)
    good = {}
    for term, p, n in rows:
        ratio = ((p + 0.5) / (toxic + 1)) / ((n + 0.5) / (clean + 1))
        if p >= need and ratio >= MIN_RATIO:
            good[term] = (p, math.log(ratio))
    out: dict[str, float] = {}
    for term in sorted(good, key=lambda t: (len(t), t)):
        if any(term.startswith(x) for x in out if not x.endswith(" ")):
            continue
        stem = term
        while longer := [t for t in good if t != stem and t.startswith(stem) and good[t][0] >= 0.95 * good[term][0]]:
            stem = max(longer, key=lambda t: (good[t][0], -len(t), t))
        out[stem] = good[stem][1]
        if stem != term:
            good = {t: v for t, v in good.items() if not t.startswith(stem) or t == stem}
    return out


def fit_lexicon(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Fit on at most fit_rows labelled rows outside the held-out fold; only texts and labels are looked at."""
    key = F.col(f"`{id_col}`")
    known = labels.select(key.cast("long").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    known = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(fit_rows)
    fit = df.select(key.cast("long").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t")).filter(F.col("t").isNotNull()).join(F.broadcast(known), "k")  # known: at most fit_rows pairs
    fit = fit.groupBy("k", "y").agg(F.min("t").alias("t")).select("t", "y")  # repeated ids: one text each, so at most fit_rows rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[y].update(row_terms(t))
                rows[y] += 1
        terms = [x for x in found[1]]  # words of clean rows alone never enter the lexicon
        yield pa.RecordBatch.from_arrays([pa.array(["", *terms]), pa.array([rows[1], *(found[1][x] for x in terms)], pa.int64()), pa.array([rows[0], *(found[0][x] for x in terms)], pa.int64())], ["term", "p", "n"])

    def clean_count(terms: frozenset[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter = Counter()
            for b in batches:
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not y:
                        n.update(row_terms(t) & terms)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

        return run

    fit = fit.repartition(F.xxhash64("t") % 64).cache()
    try:
        counts = fit.mapInArrow(count, "term string, p bigint, n bigint").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        sizes = counts.filter("term = ''").collect()
        toxic, clean = (sizes[0]["p"], sizes[0]["n"]) if sizes else (0, 0)
        need = max(MIN_ROWS, MIN_SHARE * toxic)
        often = {r["term"]: r["p"] for r in counts.filter((F.col("term") != "") & (F.col("p") >= need)).collect()}  # bounded by the fit rows
        rest = fit.mapInArrow(clean_count(frozenset(often)), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
        n_clean = {r["term"]: r["n"] for r in rest}
        weights = pick_terms([(t, p, n_clean.get(t, 0)) for t, p in often.items()], toxic, clean)
        draft = Lexicon(weights, exceptions, 1.0)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = draft.automaton() if draft.weights else None
            for b in batches:
                d = [draft.density(t, a) if a else 0.0 for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.float64()), b.column(1)], ["d", "y"])

        points = fit.mapInArrow(measure, "d double, y int").toPandas()  # at most the fit rows
    finally:
        fit.unpersist()
    return Lexicon(weights, exceptions, middle_density(points["d"].to_numpy(), points["y"].to_numpy()))


def middle_density(d: np.ndarray, y: np.ndarray) -> float:
    """The density with the fewest wrong labels, half-way to the next one below."""
    at = np.unique(d)
    if len(at) < 2:
        return 1.0
    pos, neg = np.sort(d[y == 1]), np.sort(d[y == 0])
    wrong = np.searchsorted(pos, at[1:]) + len(neg) - np.searchsorted(neg, at[1:])
    i = int(np.argmin(wrong)) + 1
    return float((at[i] + at[i - 1]) / 2)


def score_toxicity(df: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (1 from 0.5 on).

    A null or empty text scores 0. Repeated rows get equal scores, an empty table gives no rows. Without toxic
    labels the lexicon is empty and all score 0. A kept column named like a result column keeps its name, and the
    result's gets an underscore.
    """
    src = df.select(*kept_columns(keep), F.col(f"`{text_col}`").cast("string").alias("scored_text"))
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton() if lexicon.weights else None
        for b in batches:
            s = np.array([lexicon.score(lexicon.density(t, a)) if t and a else 0.0 for t in b.column(len(keep)).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema.names)

    return restored(src.mapInArrow(run, schema), keep, ["score", "predicted"])
