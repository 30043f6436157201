"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, names (capitalised words inside a sentence) and units (after a
number) become typed placeholders, other words stay, in lower case. Where a text has names, a second form keeps them
as words, so that a copy in capitals, in lower case or with every word capitalised still meets its item. Windows of five template tokens are hash-joined
between documents and benchmark items. A window of placeholders alone says nothing, so it has the hash of its words as they are and counts
only in verbatim runs; an item with under `DISTINCT` different words besides placeholders has such windows only, so it has to stand in a document word for word.

Matched windows on one diagonal (the same shift between item and document)
belong together, and so do diagonals within a few words of each other, as inserted or deleted words shift the rest. They
count if they cover enough of the item's windows, or all but those one edited word breaks, and if the fillers of their
slots are consistent: each filler of the item always has the same filler in the document, and the reverse. So a
question asked again with other numbers or names is caught, and one that mixes them up is not. A run of 13 words
with the item's own fillers counts whatever its share of the item.

Not every window that an item shares with a document makes the two a pair, as stock phrases stand in many items and many documents.
Of an item that may miss m windows, the m + 1 that the fewest items have are seeds (a document that covers enough has one of
them), and so is the rarest window of each run of nine (a verbatim run of 13 words has one of them). Only pairs that share a seed
are looked at window by window, and a window that is repeated in either is one row of that pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, only, slices, table, table_of, texts
from wardcraft.plans.shared import materialise

WINDOW, COVERAGE = 5, 0.8
#: Words between neighbouring diagonals that are taken together, and words of a verbatim run that counts by itself.
NEAR, RUN = 5, 13
#: An item with fewer different words than DISTINCT besides placeholders is taken word for word; one of under RUN words with fewer than EVIDENCE besides
#: placeholders counts only where it is the whole document.
DISTINCT, EVIDENCE = 4, 2
#: Window hashes of a benchmark up to this many bytes are sent to all tasks, to send on only windows that will match.
FILTER_BYTES = 64 << 20
#: Words that are units when they follow a number. Fixed values.
UNITS = "km m cm mm mi miles mile ft feet foot inch inches yd yards kg g mg lb lbs pounds oz tons ton l ml liters liter litres gallons h hr hrs hours hour min mins minutes minute s sec secs seconds second days day weeks week months month years year percent dollars dollar euros euro cents cent usd eur gbp mph kmh kph degrees degree celsius fahrenheit w kw v hz khz mhz ghz kb mb gb tb".split()

_WORD = table_of("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_WORD[128:] = True
_DIGIT = table_of("0123456789")
_STOP = table_of(".!?\n:;")
_P, _Q = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))
#: What sets hashes of words as they are apart from those of template tokens.
_LITERAL = np.uint64(0xA5A5A5A5A5A5A5A5)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The powers of _P, grown as longer texts come; kept, as every text needs them."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), _P, np.uint64))])
    return _POWERS[:n]


def _lower(text: bytes) -> bytes:
    """The text in lower case, every character at its old place; one whose lower case takes other bytes stays."""
    if text.isascii():
        return text.lower()
    whole = text.decode()
    found = whole.lower().encode()
    if len(found) == len(text):
        a, b = np.frombuffer(found, np.uint8), np.frombuffer(text, np.uint8)
        if np.array_equal(a & 0xC0 == 0x80, b & 0xC0 == 0x80):
            return found
    return "".join([x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in whole]).encode()


def template(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template tokens, word hashes, whether a slot, whether a name) of a text in UTF-8; arrays over its words."""
    b = np.frombuffer(text, np.uint8)
    low = np.frombuffer(_lower(text), np.uint8)
    word = _WORD[b]
    digit = _DIGIT[b]
    if len(b) > 2:  # a point or comma between digits is part of a number
        word[1:-1] |= ((b[1:-1] == 46) | (b[1:-1] == 44)) & digit[:-2] & digit[2:]
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        empty = np.zeros(0, np.uint64)
        return empty, empty, np.zeros(0, bool), np.zeros(0, bool)
    # a polynomial hash of each word, from its end, so that only the word's own length matters
    length = end - start
    at = np.flatnonzero(word)
    back = np.repeat(end, length) - 1 - at
    own = np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[back], np.r_[0, np.cumsum(length)[:-1]])
    own = _mix(own ^ (length.astype(np.uint64) * _Q))
    digits = np.add.reduceat((digit | (b == 46) | (b == 44))[at].astype(np.int64), np.r_[0, np.cumsum(length)[:-1]])
    number = (digits == length) & digit[start]
    stops = np.r_[0, np.cumsum(_STOP[b])]
    fresh = np.r_[True, stops[start[1:]] > stops[end[:-1]]]
    changed = np.r_[b != low, False, False, False, False]
    wide = 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)  # bytes of the character that begins here
    capital = lambda i: changed[i] | (wide[i] > 1) & changed[i + 1] | (wide[i] > 2) & changed[i + 2] | (wide[i] > 3) & changed[i + 3]
    second = start + wide[start]
    name = capital(start) & ~fresh & (second < end) & ~capital(np.minimum(second, len(b) - 1))
    unit = np.r_[False, number[:-1]] & np.isin(own, _UNIT_HASHES)
    name &= ~unit
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, own)))
    return token, own, number | unit | name, name


_UNIT_HASHES = np.zeros(0, np.uint64)
_UNIT_HASHES = np.sort(template("\n".join(UNITS).encode())[1])


def window_hashes(token: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` template tokens."""
    n = len(token) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = _mix(out * _P + token[k : k + n])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _hashes(token: np.ndarray, own: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether void) of the windows of a form: of template tokens, or of words as they are where a window has placeholders alone."""
    h = window_hashes(token, size)
    words = np.r_[0, np.cumsum(~slot)]
    void = words[size:] == words[:-size]
    at = np.flatnonzero(void)
    if len(at):
        h[at] = window_hashes(own[(at[:, None] + np.arange(size)).ravel()], size)[::size] ^ _LITERAL
    return h, void


def _grouped(hashes: np.ndarray, at: np.ndarray, own: np.ndarray, slot: np.ndarray, void: np.ndarray, size: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """(hash, places, fillers at each) of the windows at `at`, whose hashes are given: one entry for each hash. A void window has no fillers, as its words are in the hash."""
    if not len(at):
        return []
    order = np.argsort(hashes, kind="stable")
    hashes, at = hashes[order].view(np.int64).tolist(), at[order].tolist()
    out: list[tuple[int, list[int], list[list[int]]]] = []
    for h, place in zip(hashes, at, strict=True):
        if not out or out[-1][0] != h:
            out.append((h, [], []))
        out[-1][1].append(place)
        held = slot[place : place + size]
        out[-1][2].append(own[place : place + size][held].view(np.int64).tolist() if held.any() and not void[place] else [])
    return out


def _item(text: bytes):
    """(form, size, words, windows that count, whether the whole document has to match, own, slots, hashes, void, words besides placeholders in each window) of each form of an item."""
    token, own, slot, name = template(text)
    size, n = min(WINDOW, len(token)), len(token)
    if not n:
        return
    words = len(token) - int(slot.sum())
    if len(np.unique(token[~slot])) < DISTINCT:
        none = np.zeros(n, bool)
        h = window_hashes(own, size) ^ _LITERAL
        yield 2, size, n, len(h), words < EVIDENCE and n < RUN, own, none, h, np.zeros(len(h), bool), np.full(len(h), size)
        return
    for form, tokens, slots in _forms(token, own, slot, name):
        h, void = _hashes(tokens, own, slots, size)
        solid = np.r_[0, np.cumsum(~slots)]
        if not void.all():
            yield form, size, n, int((~void).sum()), False, own, slots, h, void, solid[size:] - solid[:-size]


def _forms(token, own, slot, name):
    """Form 1 has names as words."""
    yield 0, token, slot
    if name.any():
        yield 1, np.where(name, own, token), slot & ~name


def _items(batches):
    """Rows of (key, text) -> a row for each item, form and window hash."""
    only(None)
    kinds = [*[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    for batch in (part for whole in batches for part in slices(whole)):
        for key, text in zip(batch.column("key").to_pylist(), texts(batch), strict=True):
            for form, size, words, windows, whole, own, slots, h, void, solid in _item(text):
                rows = _grouped(h, np.arange(len(h)), own, slots, void, size)
                first = [r[1][0] for r in rows]
                yield as_batch(list(_ITEM), kinds, [[key] * len(rows), [form] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], void[first], [words] * len(rows), [windows] * len(rows), [whole] * len(rows), solid[first], [size] * len(rows)])


_ITEM = ("item_id", "form", "hash", "places", "item_fill", "void", "words", "windows", "whole", "solid", "size")
_ITEM_SCHEMA = "item_id long, form long, hash long, places array<long>, item_fill array<array<long>>, void boolean, words long, windows long, whole boolean, solid long, size long"


def _documents(literal, among):
    """Rows of (key, text) -> a row for each document and window hash that an item may have.

    literal: sizes of windows that items need as they stand. Of form 1 only the windows that hold a name are new.
    """

    def run(batches):
        only(None)
        kinds = [*[pa.int64()] * 2, pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.int64()]

        def known(h: np.ndarray, at: np.ndarray) -> np.ndarray:
            if among is None or not len(at):
                return at
            found = among.value
            return at[found[np.minimum(np.searchsorted(found, h[at]), len(found) - 1)] == h[at]] if len(found) else at[:0]

        for batch in (part for whole in batches for part in slices(whole)):
            for key, text in zip(batch.column("key").to_pylist(), texts(batch), strict=True):
                token, own, slot, name = template(text)
                rows = []
                if len(token) >= WINDOW:
                    for form, tokens, slots in _forms(token, own, slot, name):
                        h, void = _hashes(tokens, own, slots, WINDOW)
                        at = np.arange(len(h))
                        if form:
                            names = np.r_[0, np.cumsum(name)]
                            at = at[names[WINDOW:] > names[:-WINDOW]]
                        at = known(h, at)
                        rows += _grouped(h[at], at, own, slots, void, WINDOW)
                for size in literal.value if len(token) else []:
                    h = window_hashes(own, size) ^ _LITERAL
                    at = known(h, np.arange(len(h)))
                    none = np.zeros(len(own), bool)
                    rows += _grouped(h[at], at, own, none, none, size)
                rows = _merged(rows)
                for k in range(0, len(rows), 50_000):
                    part = rows[k : k + 50_000]
                    yield as_batch(["doc_id", "hash", "at", "doc_fill", "doc_words"], kinds, [[key] * len(part), [r[0] for r in part], [r[1] for r in part], [r[2] for r in part], [len(token)] * len(part)])

    return run


def _merged(rows: list[tuple[int, list[int], list[list[int]]]]) -> list[tuple[int, list[int], list[list[int]]]]:
    """One entry for each hash: a void window is in the literal ones again, and a word may be a name elsewhere."""
    out: dict[int, tuple] = {}
    for h, places, fill in rows:
        if h in out:
            seen = set(out[h][1])
            new = [k for k, x in enumerate(places) if x not in seen]
            out[h] = (h, out[h][1] + [places[k] for k in new], out[h][2] + [fill[k] for k in new])
        else:
            out[h] = (h, places, fill)
    return list(out.values())


_DOC_SCHEMA = "doc_id long, hash long, at array<long>, doc_fill array<array<long>>, doc_words long"


def least_covered(windows, coverage):
    """The share of an item's windows that is enough: an edited word breaks WINDOW of them."""
    return min(coverage, (windows - WINDOW) / windows) if windows >= 2 * WINDOW else coverage


def _consistent(pairs: set) -> bool:
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _outwards(chain: list[int], seed: int, by: dict) -> Iterator[int]:
    """The shifts of a chain by their distance from the seed, those of more windows first, as far as they are asked for."""
    right = bisect_left(chain, seed)
    left = right - 1
    while left >= 0 or right < len(chain):
        a = seed - chain[left] if left >= 0 else None
        b = chain[right] - seed if right < len(chain) else None
        if b is None or a is not None and (a < b or a == b and len(by[chain[left]]) >= len(by[chain[right]])):
            yield chain[left]
            left -= 1
        else:
            yield chain[right]
            right += 1


def held_whole(windows: int, hits: list[dict]) -> bool:
    """Whether one diagonal has all of an item's windows, with consistent slots. Only the fullest diagonals are looked at, so that texts that repeat themselves cost little."""
    solid = [h for h in hits if not h["void"]]
    if sum(len(h["places"]) for h in solid) < windows:
        return False
    shifts, counts = np.unique(np.concatenate([np.subtract.outer(np.array(h["at"], np.int64), np.array(h["places"], np.int64)).ravel() for h in solid]), return_counts=True)
    for shift in shifts[counts == windows][:16].tolist():
        pairs: set = set()
        for h in solid:
            at = {a: k for k, a in enumerate(h["at"])}
            for p, fill in zip(h["places"], h["item_fill"], strict=True):
                if (k := at.get(p + shift)) is not None:
                    pairs.update(zip(fill, h["doc_fill"][k], strict=True))
        if _consistent(pairs):
            return True
    return False


def covered(words: int, windows: int, hits: list[tuple[int, int, list, bool]], coverage: float) -> float:
    """The share of an item's windows that a document holds, 0 if too few.

    hits: place in the document, in the item, fillers (item, document), whether void. Void windows count in verbatim runs only.
    """
    least = least_covered(windows, coverage)
    by: dict[int, dict[int, set]] = {}
    exact: dict[int, list[int]] = {}
    for at, place, fillers, void in hits:
        if not void:
            by.setdefault(at - place, {})[place] = set(fillers)
        if all(x == y for x, y in fillers):
            exact.setdefault(at - place, []).append(place)
    best, shifts = 0.0, sorted(by)
    cuts = [0, *[k for k in range(1, len(shifts)) if shifts[k] - shifts[k - 1] > NEAR], len(shifts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        chain = shifts[a:b]
        if len(set().union(*(by[s] for s in chain))) / windows < max(least, best):
            continue
        own = {s: set().union(*by[s].values()) for s in chain}
        for seed in sorted(chain, key=lambda s: (-len(by[s]), s)):
            if best >= 1:
                break
            if not _consistent(own[seed]):
                continue
            low = high = seed
            places, pairs = set(by[seed]), own[seed]
            for s in _outwards(chain, seed, by):
                if len(places) == windows:
                    break
                if low - NEAR <= s <= high + NEAR and _consistent(pairs | own[s]):
                    places, pairs, low, high = places | set(by[s]), pairs | own[s], min(low, s), max(high, s)
            if (found := len(places) / windows) >= least:
                best = max(best, found)
    for places_ in exact.values() if not best and words >= RUN else ():
        run, last = 0, None
        for p in sorted(set(places_)):
            run = run + 1 if last == p - 1 else 1
            last = p
            if run + WINDOW - 1 >= RUN:
                best = max(best, min(1.0, run / windows))
    return best


def _judged(coverage: float):
    def run(batches):
        only(None)
        for batch in (part for whole in batches for part in slices(whole)):
            doc, item, words, windows, hits = (c.to_pylist() for c in batch.columns)
            found = []
            for w, n, x in zip(words, windows, hits, strict=True):
                if held_whole(n, x):
                    found.append(1.0)
                    continue
                each = [(a, p, list(zip(f, d, strict=True)), h["void"]) for h in x for a, d in zip(h["at"], h["doc_fill"], strict=True) for p, f in zip(h["places"], h["item_fill"], strict=True)]
                found.append(covered(w, n, each, coverage))
            good = [k for k, x in enumerate(found) if x]
            yield as_batch(["doc_id", "item_id", "coverage"], [pa.int64(), pa.int64(), pa.float64()], [[y[k] for k in good] for y in (doc, item, found)])

    return run


def item_classes(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text) -> item_id, class_id: items of equal text have the smallest id of them, which stands for all. A null text counts as empty; null ids are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    least = items.groupBy("text").agg(F.min("item_id").alias("class_id"))
    return items.join(least, "text").select("item_id", "class_id").distinct()


def _seeds(made: DataFrame, coverage: float) -> DataFrame:
    """(hash, item_id) of an item's windows of which any document that holds the item has one."""
    rare = made.join(made.groupBy("hash").agg(F.count_distinct("item_id").alias("among")), "hash")
    each = rare.select("item_id", "form", "hash", "void", "windows", "words", "among", F.explode("places").alias("place"), "solid")
    by = F.struct("among", -F.col("solid"), "place", "hash")
    of = Window.partitionBy("item_id", "form")
    least = F.when(F.col("windows") >= 2 * WINDOW, F.least(F.lit(coverage), (F.col("windows") - WINDOW) / F.col("windows"))).otherwise(coverage)
    may_miss = F.col("windows") - F.ceil(least * F.col("windows") - 1e-9)
    first = each.where("not void").withColumn("k", F.row_number().over(of.orderBy("among", -F.col("solid"), "place"))).where(F.col("k") <= may_miss + 1).select("hash", "item_id")
    runs = each.where(F.col("words") >= RUN).select("item_id", F.min(by).over(of.orderBy("place").rowsBetween(Window.currentRow, RUN - WINDOW)).alias("s"))
    return first.union(runs.select("s.hash", "item_id")).distinct()


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage) of documents that hold an item or a re-parameterised form of it.

    coverage: the share of the item's windows on the document's best consistent chain of diagonals; at least the one asked
    for, unless only one edited word is in the way or RUN words in a row are there as they are. An item of fewer than five words is one window.
    Items with few words besides placeholders are taken word for word, and short ones with under EVIDENCE only as whole documents. Items and documents without words
    match nothing; null ids match nothing, as they can't be named; items of equal text are compared once, and their smallest id stands for them
    (`item_classes` has the others). Repeated rows of a document count once, and rows that share a doc_id count as one document; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.where("key is not null").groupBy("text").agg(F.min("key").alias("key"))
    made = materialise(spark, items.select("key", "text").mapInArrow(_items, _ITEM_SCHEMA), "items")
    literal = [r["size"] for r in made.where("form = 2").select("size").distinct().collect()]  # 1 to WINDOW
    hashes = made.select("hash").distinct()
    among = None
    if 8 * hashes.count() <= filter_bytes:
        known = np.sort(hashes.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
        among = spark.sparkContext.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")).where("key is not null")
    found = rows.mapInArrow(_documents(spark.sparkContext.broadcast(literal), among), _DOC_SCHEMA)
    found = materialise(spark, found, "windows")
    pairs = found.select("doc_id", "hash").join(_seeds(made, coverage), "hash").select("doc_id", "item_id").distinct()
    both = found.join(pairs, "doc_id").join(made, ["item_id", "hash"]).where("not whole or words = doc_words")
    each = both.groupBy("doc_id", "item_id", "form").agg(F.first("words").alias("words"), F.first("windows").alias("windows"), F.collect_list(F.struct("at", "places", "doc_fill", "item_fill", "void")).alias("hits"))
    good = each.select("doc_id", "item_id", "words", "windows", "hits").mapInArrow(_judged(coverage), "doc_id long, item_id long, coverage double")
    return good.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs, with all their columns, that hold no benchmark item. Rows without a doc_id stay."""
    gone = materialise(spark, contaminated(spark, docs, benchmark, **kw).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contaminated(spark, docs, table(spark, sf_dir, "benchmark"))
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"), F.max("coverage").alias("coverage"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.col("item_id").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"))
