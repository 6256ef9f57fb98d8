"""Benchmark decontamination by template canonicalisation.

Numbers, units behind a number and names become typed placeholders; windows of canonical tokens that are literal enough
are hash-joined between documents and benchmark items; a joined window counts only if its slots agree: equal values on the
benchmark side have equal values on the document side. Next to these, windows of the values themselves, symbols included,
are joined whatever their tokens are, so verbatim questions are all caught, and re-parameterised ones where words tell.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import land, raw, sliced, small_batches

#: Tokens of a window; items shorter than that are matched whole, by placeholders from SHORTEST tokens on, by values always.
WINDOW, SHORTEST = 13, 6
#: Share of a window's tokens that must be literal for a match by placeholders.
LITERAL_SHARE = 0.5
#: The prefilter is a bitmap of this many bits whatever the benchmark's size; the join decides.
FILTER_BITS = 22
#: Bytes of text that are canonicalised together, and words a worker remembers.
GROUP_BYTES, REMEMBERED = 1 << 22, 1 << 18

LITERAL, NUMBER, UNIT, NAME, SYMBOL = 0, 1, 2, 3, 4
# Unit words that become a placeholder behind a number.
UNITS = frozenset("""
mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs oz ounce ounces ton tons
ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months
year years hz khz mhz ghz v w kw j kj cal kcal pa kpa bar k c f n mol kmh mph km/h m/s degree degrees percent % dollar dollars cent cents
euro euros usd eur gbp pound pounds meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters
""".split())
_EDGES = regex.compile(r"^[^\p{L}\p{N}%]+|[^\p{L}\p{N}%]+$")
_NUMBER = regex.compile(r"(\p{N}[\p{N}.,:/]*)([\p{L}%]{0,6})")
# Scripts without spaces: each character with its marks is a token; the rest of such a word is cut at punctuation.
_BARE_SCRIPT = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
_SPACELESS = regex.compile(rf"[{_BARE_SCRIPT}]")
_PIECES = regex.compile(rf"(?V1)[{_BARE_SCRIPT}--\p{{M}}]\p{{M}}*|[\p{{L}}\p{{N}}\p{{M}}%--[{_BARE_SCRIPT}]]+")
_NO_SYMBOL = regex.compile(r"[^\p{S}*/\-−–^%&#@\\]+")
_ASCII_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "%")
_ENDS = (".", "!", "?", ":", "…")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _code(literal: str) -> int:
    return xxhash.xxh64_intdigest(literal, seed=7)


_PLACEHOLDER = np.array([0, _code("<number>"), _code("<unit>"), _code("<name>"), 0], np.uint64)  # no word keeps its angle brackets


class _Known(dict):
    """Word numbers; a new word is added to its lexicon."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, word: bytes) -> int:
        return self.add(word)


class Lexicon:
    """Tokens of distinct words, worked out once; word numbers index flat arrays."""

    def __init__(self):
        self.known = _Known(self.add)
        self.first, self.count, self.ends = array("q"), array("q"), array("b")
        self.codes, self.kinds, self.values = array("Q"), array("b"), []

    def add(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        bare = text.strip(_ASCII_EDGES)
        if not bare.isalpha():
            bare = _EDGES.sub("", text)
        self.first.append(len(self.codes))
        if not bare:
            symbols = _NO_SYMBOL.sub("", text)
            tokens = ((_code(symbols), SYMBOL, symbols),) if symbols else ()
        elif not bare.isascii() and _SPACELESS.search(bare):
            tokens = [t for piece in _PIECES.findall(bare) for t in self.tokens(piece)]
        else:
            tokens = self.tokens(bare)
        for code, kind, value in tokens:
            self.codes.append(code)
            self.kinds.append(kind)
            self.values.append(value)
        self.count.append(len(tokens))
        self.ends.append(text.rstrip("\"')]”»").endswith(_ENDS))
        self.known[word] = number = len(self.first) - 1
        return number

    @staticmethod
    def tokens(bare: str) -> tuple[tuple[int, int, str], ...]:
        """Code of the value, kind and value of each token."""
        if not bare.isalpha() and (number := _NUMBER.fullmatch(bare)):
            return ((_code(number[1]), NUMBER, number[1]), (_code(number[2].lower()), UNIT, number[2]))[:2 if number[2] else 1]
        lower = bare.lower()
        kind = UNIT if lower in UNITS else NAME if bare[0].isupper() and not bare.isupper() else LITERAL
        return ((_code(lower), kind, bare),)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def table(self, name: str, kind: type) -> np.ndarray:
        """A copy, since the array behind it may grow."""
        return np.array(getattr(self, name), kind)


def _hashes(codes: np.ndarray, owner: np.ndarray, lengths: list[int], seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each length with the hashes of all windows of so many tokens, across texts too; lengths ascend."""
    running = np.full(len(codes), seed, np.uint64)
    for k in range(1, max(lengths, default=0) + 1):
        n = len(codes) - k + 1
        if n <= 0:
            return
        running = (running[:n] ^ codes[k - 1:]) * _STEP
        running ^= running >> np.uint64(29)
        if k in lengths:
            yield k, (running ^ np.uint64(k)) * _STEP


class Tokens:
    """Canonical tokens of several texts in a row: codes, kinds, value numbers and the text each belongs to.

    ``exact`` and ``exact_owner`` are the codes of the values and their texts, symbols included; the rest is without symbols.
    """

    def __init__(self, texts: list[bytes | None], lexicon: Lexicon):
        split = [(t or b"").split() for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        words = lexicon.numbers([w for s in split for w in s])
        owner = np.repeat(np.arange(len(texts)), sizes)
        opens = np.ones(len(words), bool)  # a name cannot be told at the start of a sentence
        if len(words):
            opens[1:] = lexicon.table("ends", bool)[words[:-1]] | (owner[1:] != owner[:-1])
        count, first = lexicon.table("count", np.int64), lexicon.table("first", np.int64)
        n = count[words]
        at = np.repeat(np.arange(len(words)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        value = first[words][at] + within
        owner = owner[at]
        kind = lexicon.table("kinds", np.int8)[value] if len(at) else np.zeros(0, np.int8)
        self.exact = lexicon.table("codes", np.uint64)[value] if len(at) else np.zeros(0, np.uint64)
        self.exact_owner, codes = owner, self.exact
        if (kind == SYMBOL).any():
            told = kind != SYMBOL
            value, owner, kind, codes, at = value[told], owner[told], kind[told], codes[told], at[told]
        behind = np.zeros(len(at), bool)
        if len(at):
            behind[1:] = (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])
        kind[(kind == UNIT) & ~behind] = LITERAL
        kind[(kind == NAME) & opens[at]] = LITERAL
        self.value, self.owner, self.kind = value, owner, kind
        self.codes = np.where(kind == LITERAL, codes, _PLACEHOLDER[kind])
        self.starts = np.searchsorted(self.owner, np.arange(len(texts)))
        self.exact_starts = np.searchsorted(self.exact_owner, np.arange(len(texts)))
        self.lexicon = lexicon

    def windows(self, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, positions and hashes of all windows of one text with enough literals."""
        literal = np.r_[0, np.cumsum(self.kind == LITERAL)]
        for length, hashes in _hashes(self.codes, self.owner, lengths, 1):
            n = len(hashes)
            at = np.flatnonzero((self.owner[length - 1:] == self.owner[:n]) & (literal[length:] - literal[:n] >= LITERAL_SHARE * length))
            yield length, at, hashes[at]

    def exact_windows(self, lengths: list[int], bitmap: np.ndarray | None = None, shift: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, positions and hashes of all windows of values of one text, or of those that the bitmap knows."""
        for length, hashes in _hashes(self.exact, self.exact_owner, lengths, 2):
            at = np.arange(len(hashes)) if bitmap is None else np.flatnonzero(bitmap[(hashes >> np.uint64(shift)).astype(np.int64)])
            at = at[self.exact_owner[at] == self.exact_owner[at + length - 1]]
            yield length, at, hashes[at]

    def slots(self, at: int, length: int) -> list[str]:
        places = at + np.flatnonzero(self.kind[at:at + length] != LITERAL)
        return [self.lexicon.values[v].lower() for v in self.value[places]]


_lexicon = Lexicon()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], Tokens]]:
    global _lexicon
    for batch in sliced(batches):
        ids, texts, start = batch.column(0).to_pylist(), raw(batch.column(1)), 0
        while start < len(ids):
            stop, size = start, 0
            while stop < len(ids) and (stop == start or size < GROUP_BYTES):
                size += len(texts[stop] or b"")
                stop += 1
            if max(len(_lexicon.first), len(_lexicon.codes)) > REMEMBERED:
                _lexicon = Lexicon()
            yield ids[start:stop], Tokens(texts[start:stop], _lexicon)
            start = stop


_WINDOWS = "h long, id long, at int, n int, slots array<string>"


def _batch(hashes, ids, at, n, slots) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(hashes, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(at, pa.int32()),
                                       pa.array(n, pa.int32()), pa.array(slots, pa.list_(pa.string()))], ["h", "id", "at", "n", "slots"])


def _told(ids: list[int], tokens: Tokens, length: int, at: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Windows to be matched by placeholders, with their slots."""
    own = tokens.owner[at]
    return _batch(hashes, [ids[o] for o in own], at - tokens.starts[own], [1] * len(at), [tokens.slots(a, length) for a in at])


def _counted(ids: list[int], tokens: Tokens, at: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Windows to be matched by values: one row per text and hash, with the first place and the count; they have no slots."""
    own = tokens.exact_owner[at]
    order = np.lexsort((at, hashes, own))
    at, hashes, own = at[order], hashes[order], own[order]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])])
    n = np.diff(np.r_[first, len(at)])
    return _batch(hashes[first], [ids[o] for o in own[first]], at[first] - tokens.exact_starts[own[first]], n, [None] * len(first))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, tokens in _groups(batches):
        sizes = np.diff(np.r_[tokens.starts, len(tokens.codes)])
        exact_sizes = np.diff(np.r_[tokens.exact_starts, len(tokens.exact)])
        for length, at, hashes in tokens.windows(sorted({min(WINDOW, int(s)) for s in sizes if s >= SHORTEST})):
            fit = np.minimum(sizes[tokens.owner[at]], WINDOW) == length
            batch = _told(ids, tokens, length, at[fit], hashes[fit])
            yield batch.append_column("length", pa.array([length] * batch.num_rows, pa.int32()))
        for length, at, hashes in tokens.exact_windows(sorted({min(WINDOW, int(s)) for s in exact_sizes if s})):
            fit = np.minimum(exact_sizes[tokens.exact_owner[at]], WINDOW) == length
            if fit.any():
                batch = _counted(ids, tokens, at[fit], hashes[fit])
                yield batch.append_column("length", pa.array([length] * batch.num_rows, pa.int32()))


def item_windows(items: DataFrame) -> DataFrame:
    """``h, id, at, n, slots, length`` of all windows of the benchmark (``item_id``, ``text``); no slots: matched by values."""
    return (items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(_item_windows, _WINDOWS + ", length int"))


def matched_windows(docs: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Windows that a document and an item share: ``doc_id, item_id, doc_at, item_at, doc_n, item_n, doc_slots, item_slots``.

    Windows matched by values have null slots, and one row with its counts for all repeats in a text."""
    wanted = land(item_windows(small_batches(items)))
    place = F.shiftrightunsigned("h", 64 - filter_bits)
    places = wanted.select(place.alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)  # at most one per bit
    bitmap = np.zeros(1 << filter_bits, bool)
    bitmap[places] = True
    kinds = wanted.select("length", F.col("slots").isNull().alias("exact")).distinct().collect()  # at most WINDOW of either kind
    lengths, exact_lengths = (sorted(r.length for r in kinds if r.exact == exact) for exact in (False, True))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(shared.value).view(bool)
        for ids, tokens in _groups(batches):
            for length, at, hashes in tokens.windows(lengths):
                hit = bitmap[(hashes >> np.uint64(64 - filter_bits)).astype(np.int64)]
                if hit.any():
                    yield _told(ids, tokens, length, at[hit], hashes[hit])
            for _, at, hashes in tokens.exact_windows(exact_lengths, bitmap, 64 - filter_bits):
                if len(at):
                    yield _counted(ids, tokens, at, hashes)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, _WINDOWS)
    found = found.select("h", F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), F.col("n").alias("doc_n"), F.col("slots").alias("doc_slots"))
    return found.join(wanted.select("h", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("n").alias("item_n"), F.col("slots").alias("item_slots")), "h")


def contaminated(docs: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, item_id, n_windows, n_changed, verbatim`` of every document and item that share a consistent window.

    ``n_windows`` counts the shared windows whose slots agree, or if there are none the windows of equal values; ``n_changed``
    is the most slots in one of them whose value differs, ``verbatim`` is true if some window has none. A window is 13 canonical
    tokens, or a whole item of fewer. By placeholders it counts from 6 tokens on, with at least half of them literal; by values
    (in lower case, with symbols) it always counts, so an item of one common word is found in every document that has the
    word. Items without letters, digits or symbols match nothing, as do null and empty texts; a null item_id is no item; a null
    doc_id is returned as null. Repeated rows of a document add their windows up. Other columns are not read. Empty tables
    give an empty result.
    """
    windows = matched_windows(docs, items, filter_bits)
    exact = F.col("item_slots").isNull() & F.col("doc_slots").isNull()
    pairs = F.array_distinct(F.arrays_zip("item_slots", "doc_slots"))
    agree = (F.size("item_slots") == F.size("doc_slots")) & (F.size(pairs) == F.size(F.array_distinct("item_slots")))
    changed = F.when(exact, 0).otherwise(F.size(F.filter(pairs, lambda p: p["item_slots"] != p["doc_slots"])))
    n = F.col("doc_n").cast("long") * F.col("item_n")
    return (windows.where(exact | F.col("item_slots").isNotNull() & F.col("doc_slots").isNotNull() & agree).withColumn("exact", exact).withColumn("changed", changed)
            .groupBy("doc_id", "item_id").agg(F.coalesce(F.sum(F.when(~F.col("exact"), n)), F.sum(n)).alias("n_windows"),
                                              F.max("changed").cast("long").alias("n_changed"), (F.min("changed") == 0).alias("verbatim")))


#: An item must have so many letters and digits before a document is dropped for it; shorter ones are common phrases.
LEAST_CHARACTERS = 16


def drop_contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST_CHARACTERS) -> DataFrame:
    """``docs`` without the documents that hold a window of an item with at least ``least`` letters and digits; columns as given.
    Rows without a doc_id stay."""
    items = items.where(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]")) >= least)
    return docs.join(contaminated(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
