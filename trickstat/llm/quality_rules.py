"""Quality rules: counts per document, and perplexity under a character n-gram model of its language.

The model is a modified Kneser-Ney trigram model over code points (digits count as one), one for each language. Spark
counts the trigrams of all documents and derives the lower orders, discounts and back-off weights by grouping and joins. A
trigram of code points is a 63-bit number, so n-grams are never confused. A language's model is arrays of hashes,
sorted, with log probabilities and back-off weights, looked up by binary search from the longest n-gram down.

Models of up to BROADCAST_ENTRIES entries together (12 bytes each) are broadcast. Beyond, the documents' trigrams are joined
to the model's table by (language, trigram): as it is counted on the same documents, it has all of them.

A document's log perplexity is the weighted median over its lines (a quoted line in another language doesn't
move it). Each language has a band around its median: WIDTH robust deviations, widened for short lines,
down for text that is too predictable, up for text that is too odd. Medians and deviations come from
histograms over all documents.

Nulls and empty texts count nothing and fail the base rule (no words); a null lang is the language ''; repeated rows
are judged alike; a very long text is a slice of its own; further columns of any name do no harm; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mix, ngrams, slices, spans_hash, word_bounds
from .shared import stored

WIDTH = 3.5
BIN = 0.001
BROADCAST_ENTRIES = 4_000_000
#: A task passes on what it has counted when it has so many entries.
HELD = 1_000_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BREAK, BITS = 10, 21
LOW, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Entries of a model: log probabilities of 3, 2 and 1 code points, log back-off weights after two and one, log probability of a code point not seen.
TRIPLE, DOUBLE, SINGLE, AFTER_TWO, AFTER_ONE, UNKNOWN = range(6)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, digits as 0, and each text's offset in them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    points[(points >= 48) & (points <= 57)] = 48
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, before[offsets]


def trigrams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, and which of them ends at each code point; two line breaks stand before each text."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    used = np.zeros(0x110000, bool)
    used[points] = used[BREAK] = True
    symbols = np.flatnonzero(used)
    place = np.zeros(0x110000, np.int64)
    place[symbols] = np.arange(len(symbols))
    now = place[points]
    one, two = np.roll(now, 1), np.roll(now, 2)
    starts, sizes = offsets[:-1], np.diff(offsets)
    one[starts[sizes > 0]] = two[starts[sizes > 0]] = two[starts[sizes > 1] + 1] = place[BREAK]
    k = len(symbols)
    code = (two * k + one) * k + now
    if k**3 <= 16 * len(points) + 4_000_000:
        found = np.flatnonzero(np.bincount(code, minlength=k**3))
        rank = np.zeros(k**3, np.int32)
        rank[found] = np.arange(len(found))
        at = rank[code]
    else:
        found, at = np.unique(code, return_inverse=True)
    a, b, c = (symbols[x].astype(np.uint64) for x in (found // (k * k), found // k % k, found % k))
    return a << np.uint64(2 * BITS) | b << np.uint64(BITS) | c, at


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _input(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), _lang(docs).alias("lang"))


def _by_language(lang: pa.Array, offsets: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a slice, and which code points are in it (None: all)."""
    values = lang.to_pylist()
    names = sorted(set(values))
    if len(names) == 1:
        yield names[0], None
        return
    number = {name: i for i, name in enumerate(names)}
    each = np.repeat([number[v] for v in values], np.diff(offsets))
    for i, name in enumerate(names):
        yield name, np.flatnonzero(each == i)


def counted(docs: DataFrame) -> DataFrame:
    """lang, code, n: how often each trigram occurs in a language's documents, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def compact() -> int:
            for name, parts in held.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                held[name] = [(codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64))]
            return sum(len(parts[0][0]) for parts in held.values())

        def out() -> Iterator[pa.RecordBatch]:
            for name, [(codes, n)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for part, data, offsets in slices(batch):
                points, places = code_points(data, offsets)
                codes, at = trigrams(points, places)
                for name, own in _by_language(part.column("lang"), places):
                    n = np.bincount(at if own is None else at[own], minlength=len(codes))
                    some = np.flatnonzero(n)
                    held.setdefault(name, []).append((codes[some], n[some]))
                    size += len(some)
                if size > HELD and (size := compact()) > HELD // 2:
                    yield from out()
                    size = 0
        compact()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _level(rows: DataFrame) -> DataFrame:
    """rows (lang, key, context, n, lower) with p, the modified Kneser-Ney probability, and mass, the share its context leaves to lower."""
    of = {k: F.greatest(F.count(F.when(F.col("n") == k, 1)), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)}
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    within = lambda d, top: F.least(F.greatest(d, F.lit(0.1)), F.lit(top))
    cuts = rows.groupBy("lang").agg(*of.values()).select("lang", *(within(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), k - 0.1).alias(f"d{k}") for k in (1, 2, 3)))
    rows = rows.join(cuts, "lang").withColumn("taken", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    same = Window.partitionBy("lang", "context")
    rows = rows.withColumns({"total": F.sum("n").over(same), "mass": F.sum("taken").over(same) / F.sum("n").over(same)})
    return rows.withColumn("p", (F.col("n") - F.col("taken")) / F.col("total") + F.col("mass") * F.col("lower"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, kind, key, value: the entries of each language's model. counts has lang, code and n."""
    low = lambda c: c.bitwiseAND(F.lit(LOW))
    pairs = counts.groupBy("lang", F.col("code").bitwiseAND(F.lit(PAIR)).alias("key")).agg(F.count("*").alias("n"))
    pairs = stored(pairs, "pairs")
    singles = pairs.groupBy("lang", low(F.col("key")).alias("key")).agg(F.count("*").alias("n"))
    known = singles.groupBy("lang").agg((1 / (F.count("*") + 1)).alias("lower"))
    one = _level(singles.join(known, "lang").withColumn("context", F.lit(0)))
    one = stored(one.select("lang", "key", "p", (F.col("mass") * F.col("lower")).alias("unknown")), "singles")
    lower = one.select("lang", F.col("key").alias("last"), F.col("p").alias("lower"))
    two = pairs.withColumns({"last": low(F.col("key")), "context": F.shiftright("key", BITS)}).join(lower, ["lang", "last"])
    two = stored(_level(two).select("lang", "key", "p", "context", "mass"), "doubles")
    lower = two.select("lang", F.col("key").alias("last"), F.col("p").alias("lower"))
    three = counts.select("lang", F.col("code").alias("key"), "n", F.col("code").bitwiseAND(F.lit(PAIR)).alias("last"), F.shiftright("code", BITS).alias("context")).join(lower, ["lang", "last"])
    three = stored(_level(three).select("lang", "key", "p", "context", "mass"), "triples")
    entry = lambda rows, kind, key, value: rows.select("lang", F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.log(value).cast("float").alias("value"))
    out = entry(three, TRIPLE, "key", "p").unionByName(entry(two, DOUBLE, "key", "p")).unionByName(entry(one, SINGLE, "key", "p"))
    out = out.unionByName(entry(three.select("lang", "context", "mass").distinct(), AFTER_TWO, "context", "mass"))
    out = out.unionByName(entry(two.select("lang", "context", "mass").distinct(), AFTER_ONE, "context", "mass"))
    return out.unionByName(entry(one.groupBy("lang").agg(F.first("unknown").alias("unknown")).withColumn("key", F.lit(0)), UNKNOWN, "key", "unknown"))


class Model:
    """One language's entries: for each kind hashes, sorted, and their values."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
        self.kinds = []
        for k in range(6):
            hashes, own = mix(key[kind == k].astype(np.uint64)), value[kind == k]
            order = np.argsort(hashes)
            self.kinds.append((hashes[order], own[order]))

    def find(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Values by binary search, NaN for what isn't there."""
        hashes, values = self.kinds[kind]
        if not len(hashes):
            return np.full(len(keys), np.nan)
        wanted = mix(keys)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[at] == wanted, values[at].astype(float), np.nan)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        out = self.find(TRIPLE, codes)
        for keys, weights, shorter in ((np.uint64(PAIR), AFTER_TWO, DOUBLE), (np.uint64(LOW), AFTER_ONE, SINGLE)):
            rest = np.flatnonzero(np.isnan(out))
            if not len(rest):
                return out
            if shorter == DOUBLE:
                back, context = self.find(DOUBLE, codes[rest] & keys), codes[rest] >> np.uint64(BITS)
            else:
                back, context = self.find(SINGLE, codes[rest] & keys), codes[rest] >> np.uint64(BITS) & np.uint64(LOW)
                back = np.where(np.isnan(back), self.kinds[UNKNOWN][1][0] if len(self.kinds[UNKNOWN][1]) else 0.0, back) + np.nan_to_num(self.find(AFTER_TWO, codes[rest] >> np.uint64(BITS)))
            out[rest] = back + np.nan_to_num(self.find(weights, context))
        return out


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts how many of its lines equal an earlier one. Hashes find them, their bytes decide."""
    keys = mix(spans_hash(data, starts, ends)) ^ mix(text.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(order)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.flatnonzero(~new)
    bytes_ = lambda i: data[starts[i] : ends[i]].tobytes()
    same = np.fromiter((bytes_(i) == bytes_(j) for i, j in zip(order[later].tolist(), order[head[later]].tolist(), strict=True)), bool, len(later))
    if same.all():
        return np.bincount(text[order[later]], minlength=n)
    lines = list(zip(text.tolist(), map(bytes_, range(len(starts))), strict=True))  # unlike lines share a hash: compare all by their bytes
    return np.bincount(text, minlength=n) - np.bincount([t for t, _ in set(lines)], minlength=n)


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    n_words = np.diff(first)
    of_word = np.repeat(np.arange(n), n_words)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    word_chars = np.bincount(of_word, points[ends] - points[starts], minlength=n).astype(np.int64)
    n_symbols = _per_text(SYMBOLS[data], offsets)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    of_line = np.sort(np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, "right") - 1)), kind="stable")
    line_ends = np.append(line_starts[1:], len(data))
    inner = np.append(of_line[1:] == of_line[:-1], False)
    bare = line_ends - inner
    filled = np.searchsorted(starts, bare) > np.searchsorted(starts, line_starts)
    n_dup = _repeats(data, line_starts[filled], bare[filled], of_line[filled], n)

    windows = ngrams(spans_hash(data, starts, ends), 8)
    at = np.flatnonzero(of_word[: len(windows)] == of_word[7:]) if len(windows) else np.zeros(0, np.int64)
    at = at[_repeated(windows[at] ^ mix(of_word[at].astype(np.uint64)))]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 8, -1)
    n_repeat = _per_text(np.cumsum(cover[:-1]) > 0, first)

    return [x.astype(np.int64) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)]


def _lines(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of lines, breaks with the line they end, and the text of each."""
    starts = np.sort(np.concatenate((offsets[:-1], np.flatnonzero(points == BREAK) + 1)), kind="stable")
    ends = np.append(starts[1:], len(points))
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _perplexity(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, known: dict[str, Model]) -> tuple[np.ndarray, np.ndarray]:
    """Log perplexity of each text's median line and that line's length; NaN and 0 without text."""
    points, places = code_points(data, offsets)
    codes, at = trigrams(points, places)
    value = np.zeros(len(points))
    for name, own in _by_language(part.column("lang"), places):
        mine = at if own is None else at[own]
        some = np.flatnonzero(np.bincount(mine, minlength=len(codes)))
        found = np.zeros(len(codes))
        if len(some):
            found[some] = known[name].log_probability(codes[some])
        value[slice(None) if own is None else own] = found[mine]
    starts, ends, of = _lines(points, places)
    n = len(offsets) - 1
    ppl, size = np.full(n, np.nan), np.zeros(n, np.int64)
    if len(starts):
        total = np.concatenate(([0], np.cumsum(value)))
        each = -(total[ends] - total[starts]) / (ends - starts)
        order = np.lexsort((ends - starts, each, of))
        weight = np.cumsum((ends - starts)[order])
        some = np.flatnonzero(np.diff(places))
        pick = order[np.searchsorted(weight, (places[some] + places[some + 1]) / 2)]  # half of a text is in lines up to this one
        ppl[some], size[some] = each[pick], (ends - starts)[pick]
    return ppl, size


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def fitted(rows: DataFrame) -> DataFrame | dict[str, tuple[bytes, bytes, bytes]]:
    """The models: a table, or each language's kinds, keys and values where BROADCAST_ENTRIES isn't exceeded."""
    table = stored(kneser_ney(stored(counted(rows), "trigrams")), "model")
    if table.count() > BROADCAST_ENTRIES:
        return table
    got = table.toArrow()
    kind, key, value = (got.column(c).to_numpy() for c in ("kind", "key", "value"))
    names, each = np.unique(np.array(got.column("lang").to_pylist(), object), return_inverse=True)
    return {name: tuple(x[each == i].tobytes() for x in (kind, key, value)) for i, name in enumerate(names.tolist())}


def measured(rows: DataFrame, found: DataFrame | dict) -> DataFrame:
    """rows (text, lang and any others) with the five counts, log_ppl (null without text) and line_chars (length of the median line)."""
    table = found if isinstance(found, DataFrame) else None
    sent = rows.sparkSession.sparkContext.broadcast({} if table is not None else found)
    plain = table is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {name: Model(*(np.frombuffer(x, t) for x, t in zip(arrays, (np.int32, np.int64, np.float32), strict=True))) for name, arrays in sent.value.items()}
        for batch in batches:
            for part, data, offsets in slices(batch):
                ppl, size = (np.full(part.num_rows, np.nan), np.zeros(part.num_rows, np.int64)) if plain else _perplexity(part, data, offsets, known)
                extra = [pa.array(x) for x in _measure(data, offsets)] + [pa.array(ppl, mask=np.isnan(ppl)), pa.array(size)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, *NAMES, "log_ppl", "line_chars"])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {', '.join(f'{n} long' for n in NAMES)}, log_ppl double, line_chars long"
    if table is None:
        return rows.mapInArrow(run, schema)
    marked = rows.withColumn("text_hash", F.xxhash64("text"))
    out = rows.mapInArrow(run, schema).drop("log_ppl", "line_chars").withColumn("text_hash", F.xxhash64("text"))
    return out.join(_joined_perplexity(marked, table), ["lang", "text_hash"], "left").drop("text_hash")


def _joined_perplexity(rows: DataFrame, table: DataFrame) -> DataFrame:
    """lang, text_hash, log_ppl, line_chars by a join of all lines' trigrams to the model's table. Equal texts of a language count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, limit=1 << 18):
                points, places = code_points(data, offsets)
                codes, at = trigrams(points, places)
                starts, ends, of = _lines(points, places)
                line = np.repeat(np.arange(len(starts)), ends - starts)
                pair, n = np.unique(line * max(1, len(codes)) + at, return_counts=True)
                line, code = pair // max(1, len(codes)), pair % max(1, len(codes))
                row = pa.array(of[line])
                yield pa.RecordBatch.from_arrays([part.column("lang").take(row), part.column("text_hash").take(row), pa.array(line - np.searchsorted(of, of[line])), pa.array(codes[code].astype(np.int64)), pa.array(n)], ["lang", "text_hash", "line", "key", "n"])

    each = rows.select("lang", "text_hash", "text").dropDuplicates(["lang", "text_hash"]).mapInArrow(run, "lang string, text_hash long, line long, key long, n long")
    lines = each.join(table.where(F.col("kind") == TRIPLE).select("lang", "key", "value"), ["lang", "key"]).groupBy("lang", "text_hash", "line").agg((-F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("log_ppl"), F.sum("n").alias("line_chars"))
    by = Window.partitionBy("lang", "text_hash")
    upto = F.sum("line_chars").over(by.orderBy("log_ppl", "line_chars", "line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumns({"upto": upto, "whole": F.sum("line_chars").over(by)})
    return lines.where("2 * upto >= whole and 2 * (upto - line_chars) < whole").select("lang", "text_hash", "log_ppl", "line_chars")


def bands(rows: DataFrame) -> DataFrame:
    """lang, center, spread: median and robust deviation of log_ppl, from a histogram: its size depends on the range, not on the rows."""
    bins = rows.where("log_ppl is not null").groupBy("lang", F.round(F.col("log_ppl") / BIN).cast("long").alias("bin")).count()
    bins = stored(bins, "histogram")
    center = bins.groupBy("lang").agg(F.expr("percentile(bin, 0.5, count)").alias("middle"))
    off = bins.join(center, "lang").groupBy("lang").agg(F.first("middle").alias("middle"), F.expr("percentile(abs(bin - middle), 0.5, count)").alias("off"))
    return off.select("lang", (F.col("middle") * BIN).alias("center"), F.greatest(1.4826 * BIN * F.col("off"), F.lit(0.02)).alias("spread"))


def _decided(rows: DataFrame, bands_: DataFrame, width: float) -> DataFrame:
    """measured() rows with base_failed, lower, upper and kept."""
    rows = rows.join(bands_, "lang", "left")
    reach = F.sqrt(F.col("spread") * F.col("spread") + 1 / F.col("line_chars")) * width
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "lower": F.when(F.col("log_ppl").isNotNull(), F.col("center") - reach), "upper": F.when(F.col("log_ppl").isNotNull(), F.col("center") + reach)})
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(True)))


def judged(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """doc_id, the counts, base_failed, kept, log_ppl, lower and upper (its band). The counts and rules are exact."""
    rows = _input(docs)
    all_ = stored(measured(rows, fitted(rows)).drop("text"), "measured")
    return _decided(all_, bands(all_), width).select("doc_id", *NAMES, "base_failed", "kept", "log_ppl", "lower", "upper")


def passing(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """The documents, all columns as they are, that judged() keeps. While models are broadcast, texts aren't shuffled."""
    rows = _input(docs)
    found = fitted(rows)
    at = stored(bands(measured(rows, found)), "bands")
    whole = docs.select(docs["text"].cast("string").alias("text"), _lang(docs).alias("lang"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return _decided(measured(whole, found), at, width).where("kept").select("row.*")
