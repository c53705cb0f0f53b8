"""Finding and replacing terms of large lists: spans, their selection without overlaps, and the texts made of them.

Rules are a table (term, replacement) of any size. While it is small (AUTOMATON_TERMS, AUTOMATON_CHARACTERS) each task has
an Aho-Corasick automaton of all terms and goes through its texts once. Beyond that nothing of the rules is sent around but a
filter of FILTER_BITS bits. Texts are dealt to parts of PART_CHARACTERS on average; what in a part may be a term, by the filter and the lengths
that terms have, is joined to the rules by the characters themselves, each string once for each part, and each part then has an automaton of its
own terms. So what is sent grows with the texts, not with the places where terms stand. Both ways find the same spans.

Of overlapping spans the leftmost counts, of those that begin together the longest, as with an alternation of all terms.
Terms match anywhere, also within words; terms that are null or empty count as none. Of several replacements of a term the
smallest counts. Places count code points from 0; ends are exclusive. Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..streaming.tables import stored
from .alias import fuzzy_tag

AUTOMATON_TERMS = 200_000
AUTOMATON_CHARACTERS = 8_000_000
FILTER_BITS = 1 << 26
PART_CHARACTERS = 8_000_000
PIECE_BYTES = 1 << 20
HELD_NAMES = 1 << 18
PART_RECORDS = 50_000
SHARES = 8
FUZZY_PAIRS = 1_000_000
PART_WORDS = 1_000_000
PIECE_WORDS = 1 << 17
HELD_PLACES = 1 << 21
WORDS_APART = r"[^A-Za-z]+"
SPANS = "array<struct<start: int, end: int, new: string>>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str) -> str:
    """Lower case without change of length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def chosen(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of (start, end, new) those that leftmost, then longest, first win."""
    out, free = [], 0
    for start, end, new in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= free:
            out.append((start, end, new))
            free = end
    return out


def rewritten(text: str, spans: list[tuple[int, int, str]], how: str) -> str:
    """text with its spans replaced.

    how: "rules" as the replacements are; "mask" padded with blanks or cut to the length of what they stand for; "aligned"
    with what they add or save taken from the next gap of white space, of which a blank at least stays.
    """
    out, at, debt = [], 0, 0
    for start, end, new in [*spans, (len(text), len(text), "")]:
        between = text[at:start]
        bare = between.lstrip() if debt else between
        if len(bare) < len(between):
            between, debt = " " * max(len(between) - len(bare) + debt, 1) + bare, 0
        out.append(between)
        if how == "mask":
            new = new[: end - start].ljust(end - start)
        elif how == "aligned":
            debt += end - start - len(new)
        out.append(new)
        at = end
    return "".join(out)


def _hashes(text: str, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hash of as many characters from each place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for n in lengths[lengths <= len(codes)].tolist():
        value = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            value = (value ^ codes[k : len(codes) - n + 1 + k]) * _FACTOR
            value ^= value >> np.uint64(29)
        yield n, value


class Found:
    """Terms of one text by an automaton, which a task builds once."""

    def __init__(self, terms: list[str], news: list[str], ignore_case: bool) -> None:
        import ahocorasick

        self.fold = folded if ignore_case else str
        self.automaton = ahocorasick.Automaton()
        for term, new in zip(terms, news, strict=True):
            self.automaton.add_word(term, (len(term), new))
        if terms:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        if not len(self.automaton):
            return []
        return chosen([(end + 1 - n, end + 1, new) for end, (n, new) in self.automaton.iter(self.fold(text))])


def _rules(rules: DataFrame, ignore_case: bool) -> DataFrame:
    """term, new: one row per term. Terms that are equal but for case become one if case doesn't count."""
    term = F.col("term").cast("string")
    rows = rules.select((_fold(term) if ignore_case else term).alias("term"), F.col("replacement").cast("string").alias("new"))
    return rows.where("term <> ''").groupBy("term").agg(F.coalesce(F.min("new"), F.lit("")).alias("new"))


@F.pandas_udf(StringType())
def _fold(column: pd.Series) -> pd.Series:  # as folded(), so that terms and texts are folded alike
    return column.map(lambda t: t if t is None else folded(t))


def _through(df: DataFrame, key: str, text: str, rules: DataFrame, ignore_case: bool, make: Callable[[Found, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """What make gives for pieces of df and a finder of the rules' terms."""
    rows = _rules(rules, ignore_case)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term") + F.length("new")), F.lit(0)).alias("characters")).first()
    if size["n"] <= AUTOMATON_TERMS and size["characters"] <= AUTOMATON_CHARACTERS:
        return _by_automaton(df, text, rows, ignore_case, make, schema)
    return _by_join(df, key, text, rows, ignore_case, make, schema)


def with_spans(df: DataFrame, key: str, text: str, rules: DataFrame, ignore_case: bool = False) -> DataFrame:
    """df with _spans (start, end, new), the terms of rules found in text. key tells the rows of df apart (else see the module)."""

    def make(found: Found, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text).to_pylist()
        _, start, end, new, ends = _flat(found, texts)
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())])
        each = pa.StructArray.from_arrays([start, end, new], fields=list(kind))
        spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, mask=pa.array([t is None for t in texts], pa.bool_()))
        return pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, "_spans"])

    return _through(df, key, text, rules, ignore_case, make, f"{_fields(df)}, _spans {SPANS}")


def _flat(found: Found, texts: list[str | None]) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Spans of all texts: which text, start, end, new; and where those of each text end, after a 0."""
    start, end, new, sizes = [], [], [], []
    for t in texts:
        spans = found.spans(t) if t else []
        sizes.append(len(spans))
        for a, b, n in spans:
            start.append(a)
            end.append(b)
            new.append(n)
    at = np.repeat(np.arange(len(texts)), sizes)
    return at, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(new, pa.string()), np.cumsum([0, *sizes])


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """batch in slices of about PIECE_BYTES of text, so that what Python makes of one stays small however long the texts are."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64) // PIECE_BYTES
    at = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _by_automaton(df: DataFrame, text: str, rows: DataFrame, ignore_case: bool, make: Callable, schema: str) -> DataFrame:
    table = rows.toArrow()  # bounded, see _through()
    sent = df.sparkSession.sparkContext.broadcast((table.column("term").to_pylist(), table.column("new").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(*sent.value, ignore_case)
        for batch in batches:
            for piece in _pieces(batch, text):
                yield make(found, piece)

    return df.mapInArrow(run, schema)


def _filter(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of terms, and a bit for each hash. Bits travel in words of 64, so what meets is FILTER_BITS / 64 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = np.zeros(FILTER_BITS // 64, np.uint64), set()
        for batch in batches:
            for term in batch.column("term").to_pylist():
                n, value = next(_hashes(term, np.array([len(term)])))
                lengths.add(n)
                at = int(value[0]) % FILTER_BITS
                bits[at >> 6] |= np.uint64(1 << (at & 63))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, np.full(len(lengths), -1)).astype(np.int64)), pa.array(np.append(bits[some].view(np.int64), np.array(sorted(lengths), np.int64)))], ["at", "value"])

    parts = rows.select("term").mapInArrow(run, "at long, value long")
    got = parts.where("at >= 0").groupBy("at").agg(F.bit_or("value").alias("value")).unionByName(parts.where("at < 0").distinct()).toArrow()
    at, value = got.column("at").to_numpy(), got.column("value").to_numpy()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[at[at >= 0]] = value[at >= 0].view(np.uint64)
    return np.sort(value[at < 0]), bits


def _by_join(df: DataFrame, key: str, text: str, rows: DataFrame, ignore_case: bool, make: Callable, schema: str) -> DataFrame:
    lengths, bits = _filter(rows)
    sent = df.sparkSession.sparkContext.broadcast((lengths, bits))
    parts = df.agg(F.ceil(F.coalesce(F.sum(F.length(text)), F.lit(0)) / PART_CHARACTERS)).first()[0] or 1
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bits = sent.value
        held: dict[int, set[str]] = {}

        def names() -> pa.RecordBatch:
            part = np.repeat(np.array(list(held), np.int32), [len(x) for x in held.values()])
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array([t for x in held.values() for t in x], pa.string())], ["_part", "term"])

        for batch in batches:
            for part, t in zip(batch.column("_part").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                t = folded(t) if ignore_case else t
                own = held.setdefault(part, set())
                for n, value in _hashes(t, lengths):
                    at = value % np.uint64(FILTER_BITS)
                    places = np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
                    own.update([t[p : p + n] for p in places.tolist()])
                if len(own) > HELD_NAMES or len(held) > 64:
                    yield names()
                    held.clear()
        if held:
            yield names()

    texts = dealt.where(F.length(text) > 0).select("_part", F.col(text).alias("_t"))
    known = texts.repartition(parts, "_part").mapInArrow(run, "_part int, term string").join(rows, "term")

    def rewrite(left: pa.Table, right: pa.Table) -> pa.Table:
        found = Found(right.column("term").to_pylist(), right.column("new").to_pylist(), ignore_case)
        made = [make(found, piece) for batch in left.drop_columns(["_part"]).to_batches() for piece in _pieces(batch, text)]
        return pa.Table.from_batches(made or [make(found, pa.RecordBatch.from_pylist([], left.drop_columns(["_part"]).schema))])

    return dealt.groupBy("_part").cogroup(known.groupBy("_part")).applyInArrow(rewrite, schema)


def term_spans(df: DataFrame, key: str, text: str, terms: DataFrame, ignore_case: bool = False) -> DataFrame:
    """key, start, end, found: the terms that stand in text. terms: a column term."""

    def make(finder: Found, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text).to_pylist()
        at, start, end, _, _ = _flat(finder, texts)
        found = [texts[i][a:b] for i, a, b in zip(at.tolist(), start.to_pylist(), end.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), start, end, pa.array(found, pa.string())], [key, "start", "end", "found"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, start int, end int, found string"
    return _through(df.select(key, text), key, text, terms.select("term", F.lit("").alias("replacement")), ignore_case, make, schema)


def replace_terms(df: DataFrame, key: str, text: str, rules: DataFrame, how: str = "rules", ignore_case: bool = False) -> DataFrame:
    """df with the terms in text replaced in one pass; how as in rewritten()."""
    if how not in ("rules", "mask", "aligned"):
        raise ValueError(f"how is rules, mask or aligned, not {how}")
    names = df.columns

    def make(found: Found, batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else rewritten(t, found.spans(t), how) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if name == text else batch.column(name) for name in names], names)

    return _through(df, key, text, rules, ignore_case, make, _fields(df))


def select_spans(spans: DataFrame, key: str, first: str = "longest") -> DataFrame:
    """Spans (key, start, end and others) of each key without overlaps.

    first "leftmost": by start, then the longest; "longest": by length, then start. Rest of ties: by the other columns. Spans
    of a key are cut where none overlaps, and each part is folded in order, so a fold is as long as a chain of overlaps."""
    rest = [c for c in spans.columns if c not in (key, "start", "end")]
    before = Window.partitionBy(key).orderBy("start", "end", *rest).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.distinct().withColumn("_far", F.max("end").over(before))
    rows = rows.withColumn("_part", F.count(F.when(F.col("_far") <= F.col("start"), 1)).over(Window.partitionBy(key).orderBy("start", "end", *rest)))
    size = (F.col("start") - F.col("end")).alias("size")
    order = (F.col("start").alias("a"), size) if first == "leftmost" else (size, F.col("start").alias("a"))
    parts = rows.groupBy(key, "_part").agg(F.array_sort(F.collect_list(F.struct(*order, "start", "end", *rest))).alias("x"))
    clash = lambda s, t: (s["start"] < t["end"]) & (t["start"] < s["end"])
    if first == "leftmost":
        free = lambda kept, s: F.coalesce(F.try_element_at(kept, F.lit(-1))["end"] <= s["start"], F.lit(True))
    else:
        free = lambda kept, s: ~F.exists(kept, lambda t: clash(s, t))
    empty = F.filter("x", lambda s: F.lit(False))
    kept = F.aggregate("x", empty, lambda kept, s: F.when(free(kept, s), F.concat(kept, F.array(s))).otherwise(kept))
    return parts.select(key, F.explode(F.when(F.size("x") == 1, F.col("x")).otherwise(kept)).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in ("start", "end", *rest)))


class Alike:
    """Terms of several words among words, by the pairs (token, part) that match and terms (term, words, at), which a task builds once.

    A term is looked for from its word number at; the others are compared place by place."""

    def __init__(self, pairs: pa.Table, terms: pa.Table, first: str) -> None:
        self.first, terms = first, terms.sort_by("term")
        self.terms, words = terms.column("term").combine_chunks(), terms.column("words").combine_chunks()
        names = words.flatten().unique()
        self.width, self.at, self.n = len(names), _ints(terms.column("at")), _ints(pc.list_value_length(words))
        self.begin, self.parts = np.cumsum(self.n) - self.n, _ints(pc.index_in(words.flatten(), value_set=names))
        pairs = pairs.filter(pc.is_in(pairs.column("part"), value_set=names))
        self.tokens = pairs.column("token").combine_chunks().unique()
        self.pairs = np.unique(_ints(pc.index_in(pairs.column("token"), value_set=self.tokens)) * self.width + _ints(pc.index_in(pairs.column("part"), value_set=names)))
        lead = self.parts[self.begin + self.at]
        self.leads = np.argsort(lead, kind="stable")
        self.of_part = np.searchsorted(lead[self.leads], np.arange(self.width + 1))
        own, self.part = np.divmod(self.pairs, max(self.width, 1))
        self.of_token = np.searchsorted(own, np.arange(len(self.tokens) + 1))
        self.weight = np.bincount(own, np.diff(self.of_part)[self.part], len(self.tokens)).astype(np.int64)

    def spans(self, values: pa.Array, sizes: np.ndarray, pos: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among values of the first word, number of words and number of the term, of those that don't overlap. sizes: words of each text."""
        code = _ints(pc.fill_null(pc.index_in(values, value_set=self.tokens), -1))
        low, high = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.cumsum(sizes), sizes)
        places = np.flatnonzero(code >= 0)
        places = places[self.weight[code[places]] > 0]
        blocks = np.flatnonzero(np.diff(np.cumsum(self.weight[code[places]]) // HELD_PLACES)) + 1
        most = int(self.n.max(initial=0))
        found = [np.zeros(0, np.int64)]
        for p in np.split(places, blocks):
            run, k = _members(self.of_token, code[p])
            p, part = p[run], self.part[k]
            run, k = _members(self.of_part, part)
            p, term = p[run], self.leads[k]
            start, n = p - self.at[term], self.n[term]
            good = (start >= low[p]) & (start + n <= high[p])
            start, n, term = start[good], n[good], term[good]
            if pos is not None:
                good = pos[start + n - 1] - pos[start] == n - 1
                start, n, term = start[good], n[good], term[good]
            for j in range(most):
                good = (n <= j) | (self.at[term] == j)
                test = np.flatnonzero(~good)
                if len(test):
                    pair = code[start[test] + j] * self.width + self.parts[self.begin[term[test]] + j]
                    good[test] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
                    start, n, term = start[good], n[good], term[good]
            found.append(_firsts((start * (most + 1) + most - n) * len(self.terms) + term, len(self.terms)))
        if len(self.terms) == 0:
            return (np.zeros(0, np.int64),) * 3
        found = _firsts(np.concatenate(found), len(self.terms))  # in order of the place, the longest first; of equal places the smallest term
        if self.first == "leftmost":
            found = _firsts(found, len(self.terms) * (most + 1))
        at, term = np.divmod(found, len(self.terms))
        start, n = np.divmod(at, most + 1)
        n = most - n
        if self.first == "leftmost":
            kept = _apart(start, start + n)
        else:
            taken, each = np.zeros(len(values), bool), []
            for m in np.unique(n)[::-1].tolist():
                here = np.flatnonzero(n == m)
                before = np.append(0, np.cumsum(taken))
                here = here[before[start[here] + m] == before[start[here]]]
                here = here[_apart(start[here], start[here] + m)] if m > 1 else here
                for j in range(m):
                    taken[start[here] + j] = True
                each.append(here)
            kept = np.concatenate([np.zeros(0, np.int64), *each])
        return start[kept], n[kept], term[kept]

    def table(self, rows: pa.RecordBatch, key: str, kind: pa.DataType) -> pa.RecordBatch:
        """key, start, end, term of rows (key, _words and perhaps _pos)."""
        sizes = _ints(pc.fill_null(pc.list_value_length(rows.column("_words")), 0))
        ends = np.cumsum(sizes)
        pos = _ints(rows.column("_pos").flatten()) if "_pos" in rows.schema.names else None
        place, n, term = self.spans(rows.column("_words").flatten(), sizes, pos)
        text = np.searchsorted(ends, place, "right")
        start = place - (ends - sizes)[text] if pos is None else pos[place]
        return pa.RecordBatch.from_arrays([rows.column(key).take(pa.array(text)), pa.array(start).cast(kind), pa.array(start + n).cast(kind), self.terms.take(pa.array(term))], [key, "start", "end", "term"])

    def tables(self, batch: pa.RecordBatch, key: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """As table(), for batch in slices of about PIECE_WORDS words."""
        size = np.cumsum(_ints(pc.fill_null(pc.list_value_length(batch.column("_words")), 0)) + 8) // PIECE_WORDS
        at = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                yield self.table(batch.slice(a, b - a), key, kind)


def _ints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _members(ends: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member of the given runs (from ends[run] to ends[run + 1]): which of the given it is of, and its place."""
    sizes = ends[runs + 1] - ends[runs]
    of = np.repeat(np.arange(len(runs)), sizes)
    return of, np.arange(len(of)) + (ends[runs] - np.cumsum(sizes) + sizes)[of]


def _firsts(values: np.ndarray, width: int) -> np.ndarray:
    """Sorted values, of those in one interval of width the smallest."""
    values = np.sort(values)
    return values[np.append(True, np.diff(values // width) > 0)] if len(values) else values


def _apart(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of those that begin after the end of the one kept before."""
    kept, free = [], -1
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        if a >= free:
            kept.append(i)
            free = b
    return np.array(kept, np.int64)


def fuzzy_spans(words: DataFrame, key: str, terms: DataFrame, share: float = 0.75, first: str = "longest") -> DataFrame:
    """fuzzy_text_spans() for texts that are given as words (key, pos, token), of which key and pos tell one from another."""
    kind = words.schema["pos"].dataType.simpleString()
    texts = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_w"))
    return _fuzzy(texts.select(key, F.col("_w.token").alias("_words"), F.col("_w.pos").alias("_pos")), key, kind, terms, share, first)


def fuzzy_text_spans(df: DataFrame, key: str, text: str, terms: DataFrame, share: float = 0.75, first: str = "longest", pattern: str = WORDS_APART) -> DataFrame:
    """key, start, end, term: terms of one or more words among the words of text, word by word under fuzzy_match().

    Distinct words meet distinct words of terms by fuzzy_tag(), an equi-join. Each term is looked for from the word of it that matches fewest
    of the texts' words, so a common word makes few candidates; the others are then compared place by place, in the task that has the text.
    While they are FUZZY_PAIRS at most (terms as in the module) the pairs of words are broadcast; beyond, texts are dealt to parts of PART_WORDS words
    on average, each of which gets the pairs of its own words and the terms looked for from them. Words themselves aren't shuffled.
    Of overlapping spans the longest counts, then the leftmost, then the smaller term (first "leftmost": the leftmost, then the longest).
    Lengths are in words."""
    return _fuzzy(df.select(key, _words(F.col(text), pattern).alias("_words")), key, "int", terms, share, first)


def _fuzzy(texts: DataFrame, key: str, kind: str, terms: DataFrame, share: float, first: str) -> DataFrame:
    spark = texts.sparkSession
    words = stored(texts.select(F.explode("_words").alias("token")).groupBy("token").agg(F.count("*").alias("_often")), "words")
    each = terms.select("term").where(F.trim("term") != "").distinct().withColumn("_w", F.split(F.trim(F.lower("term")), r"\s+"))
    parts = each.select("term", F.size("_w").alias("n"), F.posexplode("_w").alias("j", "part"))
    pairs = stored(fuzzy_tag(words.select("token"), parts.select(F.col("part").alias("term")), share).withColumnRenamed("term", "part").join(words, "token"), "pairs")
    often = pairs.groupBy("part").agg(F.sum("_often").alias("_often"))
    known = parts.join(often, "part").groupBy("term", "n").agg(F.count("*").alias("known"), F.min_by("j", F.struct("_often", "j")).alias("at"), F.array_sort(F.collect_list(F.struct("j", "part"))).alias("_w"))
    known = stored(known.where("known = n").select("term", "at", F.col("_w.part").alias("words")), "terms")  # each part occurs at all
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, start {kind}, end {kind}, term string"
    number = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("characters")).first()
    if size["n"] <= AUTOMATON_TERMS and size["characters"] <= AUTOMATON_CHARACTERS and pairs.count() <= FUZZY_PAIRS:
        sent = spark.sparkContext.broadcast((pairs.select("token", "part").toArrow(), known.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Alike(*sent.value, first)
            for batch in batches:
                yield from found.tables(batch, key, number)

        return texts.mapInArrow(run, schema)
    count = max(-(-(words.agg(F.sum("_often")).first()[0] or 0) // PART_WORDS), 1)
    dealt = texts.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))
    own = dealt.select(F.col("_part").alias("_p"), F.explode("_words").alias("token")).distinct().join(pairs, "token").select("_p", "token", "part")
    led = own.select("_p", "part").distinct().join(known.withColumn("part", F.get("words", "at")), "part").drop("part")

    def of_part(left: pa.Table, right: pa.Table) -> pa.Table:
        term = pc.is_valid(right.column("term"))
        found = Alike(right.filter(pc.invert(term)).select(["token", "part"]), right.filter(term).select(["term", "at", "words"]), first)
        none = pa.RecordBatch.from_pylist([], left.schema)
        return pa.Table.from_batches([found.table(none, key, number), *(made for batch in left.to_batches() for made in found.tables(batch, key, number))])

    return dealt.groupBy("_part").cogroup(own.unionByName(led, True).groupBy("_p")).applyInArrow(of_part, schema)


def anonymize_records(df: DataFrame, key: str, record: str, aliases: DataFrame) -> DataFrame:
    """df with the names in the player field of record replaced by those of aliases (entity, alias), a table of any size.

    Both forms of the field are read, pn|a,b,c,d| and pn%7Ca%2Cb%2Cc%2Cd%7C; %2B in a name counts as +. Names are trimmed and
    joined in any case; unknown ones stay, empty ones too. key tells the rows of df apart. Names are taken out, joined, and put back
    by place, in partitions of PART_RECORDS rows of df on average; a name's rows are dealt to SHARES of them, each with its alias."""
    parts = max(-(-df.count() // PART_RECORDS), 1)
    bar, comma = r"(?:\||%7[Cc])", r"(?:,|%2[Cc])"
    around = rf"^(.*?(?:^|\||%7[Cc]|=)[Pp][Nn]{bar})(.*?)({bar}.*)$"
    cut = df.withColumn("_f", F.split(F.regexp_replace(record, f"(?s){around}", "$1\u0001$2\u0001$3"), "\u0001", -1))
    found = cut.where(F.size("_f") == 3).select(key, F.posexplode(F.split(F.col("_f")[1], comma, -1)).alias("_i", "_n"))
    plain = F.trim(F.regexp_replace("_n", "%2[Bb]", "+"))
    known = aliases.groupBy(F.lower("entity").alias("_e")).agg(F.min("alias").alias("_a"))
    known = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    found = found.withColumns({"_e": F.lower(plain), "_s": F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int")})
    named = found.repartition(parts, "_e", "_s").join(known.repartition(parts, "_e", "_s"), ["_e", "_s"], "left")
    new = named.select(key, "_i", "_n", "_a").repartition(parts, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_a", F.trim("_n")).alias("n")))).alias("_new"))
    out = cut.repartition(parts, key).join(new, key, "left")
    sep = F.when(F.col("_f")[1].rlike("%2[Cc]"), "%2C").otherwise(",")
    joined = F.concat(F.col("_f")[0], F.call_function("array_join", F.transform("_new", lambda x: x["n"]), sep), F.col("_f")[2])
    return out.withColumn(record, F.when(F.col("_new").isNotNull(), joined).otherwise(F.col(record))).select(*df.columns)


def _words(text: Column, pattern: str) -> Column:
    return F.array_remove(F.split(text, pattern), "")


def keyed_words(df: DataFrame, key: str, text: str | Column, pattern: str = WORDS_APART) -> DataFrame:
    """key, pos, token: the words of text, numbered."""
    text = F.col(text) if isinstance(text, str) else text
    return df.select(key, F.posexplode(_words(text, pattern)).alias("pos", "token"))
