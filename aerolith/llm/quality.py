"""Quality rules: repetition counts and n-gram perplexity under a modified Kneser-Ney model.

The model is over the characters of a text (lower-cased, digits as one, white space as one) in 4-grams, one a language.
Spark counts the grams of every whole text and derives the model from them by windows and joins; it grows with the corpus,
and no task holds it whole: a group of texts gets the log-probabilities of the grams that stand in it, as sorted arrays,
and looks them up by hash. Since the scored texts are those that were counted, every gram is scored as if its own occurrence
hadn't been counted (leave one out), and as if none had where all of them are in that text, so that junk can't vouch for
itself. Every document is scored under the model language alone and is rejected when its log-perplexity leaves that language's band (median and spread), above or below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PART, SPACED, Scratch, deal, gram_hash, group_count, kept_names, materialize, mix64, pack, packed_texts, part_rows, prefix_hash, restored, span_hash, text_bytes, unpack, unpack_all, word_spans

ORDER = 4
#: bits of a character in a key; a gram is a pair of keys: its first character and its last three
BITS = 21
LANGUAGES = ("en", "de", "fr", "es")
OTHER = "other"
#: half-width of the band in spreads, and the spread that a text of one gram has besides
WIDTH, SHORT = 5.0, 3.0
#: groups of texts whose grams one bucket merges; bytes of text whose grams are sorted at a time
MERGED, SLICE = 8, 512 << 10
GRAM = (np.uint8, np.int64, np.int64, np.uint32)  # language, first key, last key, count
SCORED = (np.uint8, np.int64, np.int64, np.uint32, np.float32, np.float32)  # ..., log-probability without one occurrence, without any

SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "base_failed", "kept"]


def _plain_characters() -> np.ndarray:
    """The character that stands for each one below 2**16 in the model."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        low = c.lower()
        out[i] = 48 if c.isdigit() else 32 if c.isspace() else ord(low) if len(low) == 1 else i
    return out


PLAIN = _plain_characters()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first keys, last keys, index of the first gram of each text with one more); grams lie within one text."""
    whole = [t.decode() for t in texts]
    size = np.array([len(t) for t in whole], np.int64)
    c = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
    c = np.where(c < 1 << 16, PLAIN[np.minimum(c, (1 << 16) - 1)], c).astype(np.int64)
    n = np.maximum(size - ORDER + 1, 0)
    start = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(start[-1]) + np.repeat(np.cumsum(size) - size - start[:-1], n)
    last = (c[:-2] << (2 * BITS)) | (c[1:-1] << BITS) | c[2:] if len(c) > 2 else c[:0]
    return c[at], last[at + 1], start


def key_hash(lang: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix64(mix64(first.view(np.uint64) + (lang.astype(np.uint64) << np.uint64(56))) ^ last.view(np.uint64))


def distinct_grams(lang: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray | None = None) -> list[np.ndarray]:
    """Language, keys and (added) counts of each gram, sorted by the keys."""
    _, at, inv, count = np.unique(key_hash(lang, first, last), return_index=True, return_inverse=True, return_counts=True)
    if n is not None:
        count = np.bincount(inv, weights=n).astype(np.int64)
    order = np.lexsort((last[at], first[at], lang[at]))
    at = at[order]
    return [lang[at], first[at], last[at], count[order]]


def lang_index(col: pa.Array, languages: tuple[str, ...]) -> np.ndarray:
    place = {x: i for i, x in enumerate(languages)}
    return np.array([place.get(x, len(languages)) for x in col.to_pylist()], np.uint8)


def _slices(packed: pa.ChunkedArray, size: np.ndarray) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first text, text after the last, texts) of about SLICE each."""
    dec, lo, end = zstandard.ZstdDecompressor(), 0, np.cumsum(size)
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + SLICE, side="right")))
        yield lo, hi, [dec.decompress(packed[i].as_py()) for i in range(lo, hi)]
        lo = hi


def count_grams(texts: DataFrame, languages: tuple[str, ...], buckets: int) -> DataFrame:
    """Each group's grams by bucket, with their counts there."""

    def run(t: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        langs, held = lang_index(t["lang"], languages), []
        for lo, hi, part in _slices(t["packed"], t["n_bytes"].to_numpy()):
            first, last, start = grams(part)
            held.append(distinct_grams(np.repeat(langs[lo:hi], np.diff(start)), first, last))
        if held:
            lang, first, last, n = distinct_grams(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = ((key_hash(lang, first, last) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            deal(bucket.astype(np.int64), t["grp"][0].as_py(), [lang, first, last, n.astype(np.uint32)], out)
        return part_rows(*out)

    return texts.groupBy("grp").applyInArrow(run, PART)


def merge_grams(parts: DataFrame) -> DataFrame:
    """(bucket, lang, first, last, n) of each gram of the corpus."""

    def run(t: pa.Table) -> pa.Table:
        lang, first, last, n = distinct_grams(*unpack_all(t, GRAM))
        return pa.table({"bucket": pa.array(np.full(len(n), t["bucket"][0].as_py(), np.int64)), "lang": pa.array(lang.astype(np.int32)), "first": pa.array(first), "last": pa.array(last), "n": pa.array(n)})

    return parts.groupBy("bucket").applyInArrow(run, "bucket bigint, lang int, first bigint, last bigint, n bigint")


# the keys of a gram's suffix in the next lower order, and what stands before its last character
SUFFIX = {3: {"last": "last"}, 2: {"last": f"last & {(1 << 2 * BITS) - 1}"}, 1: {"last": f"last & {(1 << BITS) - 1}"}}
CONTEXT = {4: ["first", f"shiftright(last, {BITS})"], 3: [f"shiftright(last, {BITS})"], 2: [f"shiftright(last, {BITS})"], 1: []}


def _level(table: DataFrame, order: int) -> DataFrame:
    """Adds s<order>: the gram's count, its context's total, and how many grams of the context occur once, twice, more often."""
    w = Window.partitionBy("lang", *[F.expr(c) for c in CONTEXT[order]])
    kinds = [F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1)), F.count(F.when(F.col("n") >= 3, 1))]
    return table.withColumn(f"s{order}", F.struct(F.col("n").alias("n"), F.sum("n").over(w).alias("total"), *[k.over(w).alias(f"n{i}") for i, k in enumerate(kinds, 1)]))


def discounts(table: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each language from the counts of counts (one row a language)."""
    rows = table.groupBy("lang").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()
    out = {}
    for r in rows:
        n1, n2, n3, n4 = (float(r[f"n{i}"]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = ((1 - 2 * y * n2 / n1 if n1 else 0.5, 1), (2 - 3 * y * n3 / n2 if n2 else 1.0, 2), (3 - 4 * y * n4 / n3 if n3 else 1.5, 3))
        out[r["lang"]] = tuple(min(max(x, 0.05), m - 0.05) for x, m in raw)
    return out


def _left_out(s: Column, d: Column, gone: Column, lower: Column) -> Column:
    """Probability of a gram's last character if so many occurrences (up to all) are taken out."""
    kind = lambda n, i: n >= 3 if i == 3 else n == i
    n, total = s["n"] - gone, s["total"] - gone
    left = lambda i: s[f"n{i}"] - kind(s["n"], i).cast("int") + kind(n, i).cast("int")
    cut = F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
    some = total > 0
    return F.when(some, F.greatest(n - cut, F.lit(0.0)) / total).otherwise(0.0) + F.when(some, (d[0] * left(1) + d[1] * left(2) + d[2] * left(3)) / total).otherwise(1.0) * lower


def kneser_ney(counts: DataFrame, save) -> DataFrame:
    """(bucket, lang, first, last, logp, logp_alone): modified Kneser-Ney with one, or every, occurrence of the gram left out.

    Lower orders count the distinct grams of the order above that end in the gram. `save` keeps intermediate tables.
    """
    levels, table = {ORDER: counts}, counts
    for order in range(ORDER - 1, 0, -1):
        table = save(table.groupBy("lang", *[F.expr(c).alias(k) for k, c in SUFFIX[order].items()]).agg(F.count(F.lit(1)).alias("n")), f"grams{order}")
        levels[order] = table
    cuts = {order: discounts(t) for order, t in levels.items()}
    size = {r["lang"]: r["v"] for r in levels[1].groupBy("lang").agg(F.count(F.lit(1)).alias("v")).collect()}  # one row a language
    per_lang = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, v)]), F.col("lang"))
    if not size:
        return counts.select("bucket", "lang", "first", "last", "n", F.lit(0.0).alias("logp"), F.lit(0.0).alias("logp_alone")).filter("false")
    lower = _level(levels[1], 1).drop("n")
    for order in range(2, ORDER + 1):
        names = {k: f"up_{k}" for k in SUFFIX[order - 1]}
        right = lower.select(F.col("lang").alias("up_lang"), *[F.col(k).alias(v) for k, v in names.items()], *[f"s{i}" for i in range(1, order)])
        left = _level(levels[order], order)
        left = left if order == ORDER else left.drop("n")
        on = [F.col("lang") == F.col("up_lang"), *[F.expr(SUFFIX[order - 1][k]) == F.col(v) for k, v in names.items()]]
        lower = left.join(right, on).drop("up_lang", *names.values())
    logp = []
    for taken in (F.lit(1), F.col(f"s{ORDER}.n")):
        gone = {ORDER: taken}
        for order in range(ORDER, 1, -1):  # a gram that is gone altogether counts no more for its suffix
            gone[order - 1] = (F.col(f"s{order}.n") == gone[order]).cast("int")
        p = 1.0 / (per_lang({k: float(v + 1) for k, v in size.items()}))
        for order in range(1, ORDER + 1):
            d = [per_lang({k: v[i] for k, v in cuts[order].items()}) for i in range(3)]
            p = _left_out(F.col(f"s{order}"), d, gone[order], p)
        logp.append(F.ln(p))
    return lower.select("bucket", "lang", "first", "last", "n", logp[0].alias("logp"), logp[1].alias("logp_alone"))


def _answers(parts: DataFrame, model: DataFrame) -> DataFrame:
    """For each group and bucket its grams with their log-probabilities."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if not a.num_rows:
            return part_rows(*out)
        key = key_hash(*(b[c].to_numpy() for c in ("lang", "first", "last")))
        order = np.argsort(key)
        key, n_all, logp, alone = key[order], *(b[c].to_numpy()[order] for c in ("n", "logp", "logp_alone"))
        for bucket, grp, n, blob in zip(*(a[c].to_pylist() for c in ("bucket", "grp", "n", "blob")), strict=True):
            lang, first, last, n_here = unpack(blob, n, GRAM)
            at = np.searchsorted(key, key_hash(lang, first, last))
            own = n_here == n_all[at]  # where other groups have the gram too, no text has all its occurrences
            for o, x in zip(out, (bucket, grp, n, pack(lang, first, last, np.where(own, n_here, 0).astype(np.uint32), logp[at].astype(np.float32), np.where(own, alone[at], 0).astype(np.float32))), strict=True):
                o.append(x)
        return part_rows(*out)

    return parts.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(run, PART)


class Lookup:
    """Places of keys in an array, by hash: a table with one entry a slot, and a sorted list of those that found theirs taken."""

    def __init__(self, key: np.ndarray):
        self.bits = np.uint64(max(10, int(len(key)).bit_length() + 2))
        slot = key >> (np.uint64(64) - self.bits)
        self.key, self.at = key, np.zeros(1 << int(self.bits), np.int32)
        self.at[slot] = np.arange(len(key), dtype=np.int32)
        late = np.flatnonzero(self.at[slot] != np.arange(len(key)))
        self.late = late[np.argsort(key[late])]
        self.late_keys = key[self.late]

    def find(self, key: np.ndarray) -> np.ndarray:
        out = self.at[key >> (np.uint64(64) - self.bits)]
        miss = np.flatnonzero(self.key[out] != key)
        if len(miss):
            out[miss] = self.late[np.searchsorted(self.late_keys, key[miss])]
        return out


def _scores(texts: DataFrame, answers: DataFrame, keep: list[str], languages: tuple[str, ...]) -> DataFrame:
    """The kept columns, counts, number of grams, log-perplexity and the language whose model was used."""
    names = [*keep, *[x.split()[0] for x in COUNTS.split(", ")]]
    schema = T.StructType([*texts.select(*names).schema.fields, *T._parse_datatype_string("n_grams bigint, log_ppl double, model_lang string").fields])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        langs = lang_index(a["lang"], languages)
        n, total = np.zeros(a.num_rows, np.int64), np.zeros(a.num_rows)
        if b.num_rows and a.num_rows:
            lang, first, last, count, logp, alone = unpack_all(b, SCORED)
            table = Lookup(key_hash(lang, first, last))
            for lo, hi, part in _slices(a["packed"], a["n_bytes"].to_numpy()):
                first, last, start = grams(part)
                n[lo:hi] = np.diff(start)
                key, row = key_hash(np.repeat(langs[lo:hi], n[lo:hi]), first, last), np.repeat(np.arange(hi - lo), n[lo:hi])
                _, at, own = np.unique(mix64(key + row.astype(np.uint64)), return_index=True, return_counts=True)  # a text's grams
                x = table.find(key[at])
                total[lo:hi] = np.bincount(row[at], weights=own * np.where(own == count[x], alone[x], logp[x]).astype(np.float64), minlength=hi - lo)
        ppl = np.where(n > 0, -total / np.maximum(n, 1), np.nan)
        return pa.table([*(a[c] for c in names), pa.array(n), pa.array(ppl, from_pandas=True), pa.array([(*languages, OTHER)[i] for i in langs], pa.string())], names=schema.names)

    return texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(run, schema)


def _counted(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
    return [pa.array(x, pa.int64()) for x in repeat_counts(data, offs)]


def row_sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])[start[1:]] - np.concatenate([[0], np.cumsum(values)])[start[:-1]]


def repeat_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row."""
    rows = len(offs) - 1
    starts, ends, first = word_spans(data, offs, SPACED)
    n_words = np.diff(first)
    chars = row_sums((SPACED[data] & ((data & 0xC0) != 0x80)).astype(np.int64), offs)
    symbols = row_sums(SYMBOL[data], offs)
    prefix = prefix_hash(data)
    doc = np.repeat(np.arange(rows), n_words)
    # words of 5-word windows that occur twice or more in their row
    h = gram_hash(span_hash(prefix, starts, ends), 5)
    whole = doc[: len(h)] == doc[4:] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    key = h[at] ^ mix64(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeat = row_sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), first)
    # lines with a word that equal an earlier line of the row
    nl = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], nl + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offs, line_start, side="right") - 1
    line_end = np.concatenate([line_start[1:], [len(data)]]) if len(line_start) else line_start
    line_end = np.minimum(line_end, offs[line_row + 1]) if len(line_start) else line_end
    closed = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(line_start) else np.zeros(0, bool)
    line_end = line_end - closed
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    s, e, r = line_start[worded], line_end[worded], line_row[worded]
    lk = span_hash(prefix, s, e) ^ mix64(r.astype(np.uint64) + np.uint64(1))
    _, firsts = np.unique(lk, return_index=True)
    dup = np.bincount(r, minlength=rows) - np.bincount(r[firsts], minlength=rows)
    return n_words, chars, symbols, dup, repeat


def quality_scores(df: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """kept_0, ..., the counts, n_grams, log_ppl (null for texts of fewer than ORDER characters) and model_lang."""
    groups = group_count(text_bytes(df, text_col))
    buckets = -(-groups // MERGED)
    with Scratch(df.sparkSession) as scratch:
        texts = scratch.save(packed_texts(df, keep, text_col, {"lang": F.col(f"`{lang_col}`").cast("string")}, COUNTS, _counted), "texts", "grp", groups)
        parts = scratch.save(count_grams(texts.select("grp", "lang", "n_bytes", "packed"), languages, buckets).repartition(buckets, "bucket"), "grams", "bucket", buckets)
        model = kneser_ney(scratch.save(merge_grams(parts), "counts"), scratch.save)
        answers = _answers(parts, scratch.save(model, "model"))
        return materialize(_scores(texts, answers, kept_names(keep), languages), "quality")


def language_bands(scored: DataFrame) -> dict[str, tuple[float, float]]:
    """Median log-perplexity of each language, and its spread over the longer half of the texts (one row a language)."""
    stat = scored.select("model_lang", "n_grams", F.col("log_ppl").alias("x")).filter(F.col("x").isNotNull())
    mid = {r["model_lang"]: (r["x"], r["n"]) for r in stat.groupBy("model_lang").agg(F.percentile_approx("x", 0.5, 10000).alias("x"), F.percentile_approx("n_grams", 0.5, 10000).alias("n")).collect()}
    if not mid:
        return {}
    least = F.element_at(F.create_map(*[F.lit(v) for k, (_, n) in sorted(mid.items()) for v in (k, n)]), F.col("model_lang"))
    ends = stat.filter(F.col("n_grams") >= least).groupBy("model_lang").agg(F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.75)), 10000).alias("p")).collect()
    return {r["model_lang"]: (mid[r["model_lang"]][0], (r["p"][1] - r["p"][0]) / 1.349) for r in ends}


def quality_rules(df: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] = LANGUAGES, width: float = WIDTH, short: float = SHORT) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl, base_failed, kept.

    A null text counts as empty; an empty text has no perplexity and fails by its word count. A null or unlisted
    language uses the model of the rest. Repeated rows get the same values. An empty table gives no rows. A result
    column whose name a kept one has gets underscores.
    """
    scored = quality_scores(df, keep, text_col, lang_col, languages)
    limits = language_bands(scored)
    inside = F.lit(True)
    for k, (mid, spread) in sorted(limits.items()):
        room = width * F.sqrt(F.lit(spread * spread) + F.lit(short * short) / F.greatest("n_grams", F.lit(1)))
        inside = F.when((F.col("model_lang") == k) & F.col("log_ppl").isNotNull(), F.abs(F.col("log_ppl") - mid) <= room).otherwise(inside)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = scored.select(*kept_names(keep), *ADDED[:6], failed.alias("base_failed"), (~failed & inside).alias("kept"))
    return restored(out, keep, ADDED)
