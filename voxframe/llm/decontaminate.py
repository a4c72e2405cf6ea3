"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words inside a
sentence) and units after a number turn into typed placeholders, the rest is
lower-cased and stripped of punctuation. Documents and benchmark items are then
compared by windows of template tokens, so a question with other numbers or
names still matches. Windows need some literal tokens to count.

Windows come in three forms: templates; folded ones, whose names are literal in
lower case, so that a copy in other case matches; and verbatim ones, all literal.
An item shorter than a window is one verbatim window of its own length.

Windows of one document that match windows of one item at the same shift form
an alignment. Its slots are consistent where each value of the item stands for
one value; equal numbers before different words are different slots. With
``whole_slots`` an inconsistent value drops the alignment, else every maximal
consistent run of windows counts by itself. A run counts if, in one form, it
covers half of the item's windows (verbatim: all), or so many that 13 tokens in
a row match. With equal values it is a verbatim copy, else a re-parameterised one.

All windows of a document are first looked up in a bit table of fixed size that
holds the items' window hashes; it has no false negatives. Only what passes is
shuffled and joined with the item windows, so the item table may be of any size.

NULL and empty texts match nothing.
Repeated rows (same id and text) give one row per item. Empty tables give no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import SEED, blocks, hand_back, mix, process_state, rolling, text_bytes

WINDOW, LITERALS, RUN = 8, 4, 13
TABLE_BITS = 22
# texts whose words a task holds at once
BLOCK = 256
TEMPLATE, FOLDED, VERBATIM = 0, 1, 2
# fixed values: units that count as such after a number
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces pound pounds ton tons ml l liter liters "
    b"litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent "
    b"dollar dollars cent cents euro euros degree degrees meter meters metre metres mph kmh kph w kw v a hz khz mhz ghz kb mb gb".split()
)
EDGES = b".,;:!?\"'()[]{}<>*#|&%$~_-+=/\\`"
NUMBER, NAME, UNIT = (np.uint64(xxhash.xxh3_64_intdigest(b"\x00" + kind, SEED) & ~15) for kind in (b"number", b"name", b"unit"))
EMPTY = np.uint64(xxhash.xxh3_64_intdigest(b"", SEED) & ~15)
IS_NUMBER, IS_CAPITAL, IS_UNIT, ENDS = 1, 2, 4, 8


class _Codes(dict):
    """Word to hash of its literal token, with four flags in the lowest bits."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(EDGES)
        text = core.decode("utf-8", "replace")
        low = text.lower().encode()
        code = xxhash.xxh3_64_intdigest(low, SEED) & ~15
        if any(c.isdigit() for c in text):
            code |= IS_NUMBER
        elif text[:1].isupper():
            code |= IS_CAPITAL
        if low in UNITS:
            code |= IS_UNIT
        if word[-1:] in b".!?" and word:
            code |= ENDS
        self[word] = code
        return code


class Template:
    """Template tokens of texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        codes = process_state("template_codes", _Codes)
        if len(codes) > 200_000:
            codes.clear()
        self.words = [w for t in texts for w in t.split()]
        counts = [len(t.split()) for t in texts]
        self.ends = np.cumsum(counts).astype(np.int64)
        self.starts = self.ends - np.array(counts, np.int64)
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        values = np.fromiter(map(codes.__getitem__, self.words), np.uint64, n)
        flags = values & np.uint64(15)
        number = flags & IS_NUMBER > 0
        fresh = np.ones(n, bool)  # starts a sentence or a text
        if n:
            fresh[1:] = flags[:-1] & ENDS > 0
            fresh[self.starts[self.starts < n]] = True
        after_number = np.zeros(n, bool)
        after_number[1:] = number[:-1] & ~fresh[1:]
        tokens = values & ~np.uint64(15)
        unit = (flags & IS_UNIT > 0) & after_number
        name = (flags & IS_CAPITAL > 0) & ~fresh & ~unit
        for at, kind in ((number, NUMBER), (name, NAME), (unit, UNIT)):
            tokens[at] = kind
        self.tokens, self.slot = tokens, number | name | unit
        exact = values & ~np.uint64(15)
        for i in np.flatnonzero(exact == EMPTY).tolist():  # signs by themselves tell formulas apart
            exact[i] = xxhash.xxh3_64_intdigest(self.words[i], SEED)
        fixed = number | unit
        self.number, self.name = number, name
        self.forms = (tokens, self.slot), (np.where(fixed, tokens, values & ~np.uint64(15)), fixed), (exact, np.zeros(n, bool))

    def windows(self, size: int, literals: int, form: int = TEMPLATE) -> tuple[np.ndarray, np.ndarray]:
        tokens, slot = self.forms[form]
        hashes = rolling(tokens, size)
        if form:
            hashes = mix(hashes + np.uint64(64 * form + (size if form == VERBATIM else 0)))
        n = len(hashes)
        slots = np.concatenate([[0], np.cumsum(slot)])
        fits = self.ends[self.doc[:n]] - np.arange(n) >= size
        if form != VERBATIM:
            fits &= slots[size : size + n] - slots[:n] <= size - literals
        at = np.flatnonzero(fits)
        return at, hashes[at]

    def word(self, at: int) -> str:
        return self.words[at].strip(EDGES).decode("utf-8", "replace").lower()

    def values(self, at: int, size: int, form: int = TEMPLATE, keyed: bool = False) -> list[str]:
        """The slot values of a window, in order; ``keyed`` puts the kind before, for a number the next word too."""
        out = []
        for i in (np.flatnonzero(self.forms[form][1][at : at + size]) + at).tolist():
            value = self.word(i)
            if keyed:
                after = self.word(i + 1) if self.number[i] and i + 1 < self.ends[self.doc[i]] else ""
                value = f"{'number' if self.number[i] else 'name' if self.name[i] else 'unit'}\n{after}\n{value}"
            out.append(value)
        return out


def _hit_rows(keys: pa.RecordBatch, template: Template, at: np.ndarray, hashes: np.ndarray, window: int, form: int, keyed: bool = False) -> pa.RecordBatch:
    doc = template.doc[at]
    slots = [template.values(int(p), window, form, keyed) for p in at]
    own = keys.take(pa.array(doc)) if keys.num_columns else keys
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(hashes.view(np.int64)), pa.array(at - template.starts[doc]), pa.array(slots, pa.list_(pa.string())), pa.array(np.full(len(at), form, np.int32))],
                                      names=[*own.schema.names, "window", "at", "slots", "form"])


def _best_run(hits: list[dict], sizes: list[int], most: int, share: float, whole_slots: bool) -> dict | None:
    """The consistent run of windows that counts and has most windows, or None."""
    by_place: dict[int, tuple[set, set]] = {}
    for hit in hits:
        forms, bound = by_place.setdefault(hit["at"], (set(), set()))
        forms.add(hit["form"])
        bound.update(zip(hit["item"], hit["doc"]))
    places = [by_place[at] for at in sorted(by_place)]
    need = [min(most, n if form == VERBATIM else -(-int(n * share * 1000) // 1000)) if n else None for form, n in enumerate(sizes)]
    stands: dict[str, dict[str, int]] = {}  # item value to document values, with the places they come from
    clashes, first, counts, best = 0, 0, [0, 0, 0], None

    def step(place: tuple[set, set], by: int) -> None:
        nonlocal clashes
        for form in place[0]:
            counts[form] += by
        for item, value in place[1]:
            seen = stands.setdefault(item, {})
            before = len(seen) > 1
            seen[value] = seen.get(value, 0) + by
            if not seen[value]:
                del seen[value]
            clashes += (len(seen) > 1) - before

    for last, place in enumerate(places):
        step(place, 1)
        if whole_slots and last + 1 < len(places):
            continue
        while clashes and not whole_slots:
            step(places[first], -1)
            first += 1
        if clashes or not any(n and counts[form] >= n for form, n in enumerate(need)):
            continue
        bound = [(item, value) for item, seen in stands.items() for value in seen]
        found = (last - first + 1, all(item.split("\n", 2)[2] == value for item, value in bound), len(bound))
        best = max(best or found, found)
    return best and {"n_windows": best[0], "verbatim": best[1], "n_slots": best[2]}


def best_run(hits: str, sizes: str, most: int, share: float, whole_slots: bool) -> Column:
    def find(rows: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([_best_run(r, n, most, share, whole_slots) for r, n in zip(rows.to_pylist(), counts.to_pylist())],
                        pa.struct([("n_windows", pa.int64()), ("verbatim", pa.bool_()), ("n_slots", pa.int64())]))

    return arrow_udf(find, "struct<n_windows:bigint,verbatim:boolean,n_slots:bigint>")(F.col(hits), F.col(sizes))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, run: int = RUN, share: float = 0.5,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", whole_slots: bool = True) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_windows, item_windows, n_slots, verbatim)``: a row per document and item it holds."""
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()

    def item_windows(batches):
        for part in (batch.slice(*block) for batch in batches for block in blocks(batch.column("text"), BLOCK)):
            template, keys = Template(part.column("text").to_pylist()), part.select(["item_id"])
            for form in (TEMPLATE, FOLDED, VERBATIM):
                at, hashes = template.windows(window, literals, form)
                yield _hit_rows(keys, template, at, hashes, window, form, True)
            counts = template.ends - template.starts
            for size in np.unique(counts[(counts > 0) & (counts < window)]).tolist():  # whole, in its own length
                at, hashes = template.windows(size, literals, VERBATIM)
                own = counts[template.doc[at]] == size
                yield _hit_rows(keys, template, at[own], hashes[own], size, VERBATIM, True)

    items = benchmark.select(F.col(item_id).alias("item_id"), text_bytes(item_text).alias("text"))
    indexed = items.mapInArrow(item_windows, f"item_id {kinds[1]}, window bigint, at bigint, slots array<string>, form int")
    lengths = items.select(F.size(F.array_remove(F.split(F.decode("text", "iso-8859-1"), r"[\x20\x09-\x0D]+"), "")).alias("n")).where(F.col("n").between(1, window - 1)).distinct()
    short = sorted(r.n for r in lengths.collect())
    # at most 2**TABLE_BITS cell numbers, whatever the size of the benchmark
    cells = indexed.select(F.shiftrightunsigned("window", 64 - TABLE_BITS).cast("int").alias("cell")).distinct()
    table = np.zeros(1 << TABLE_BITS, bool)
    table[cells.toArrow().column("cell").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table).tobytes())

    def probe(batches):
        known = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            for block in blocks(batch.column("body"), BLOCK):
                part = batch.slice(*block)
                template = Template(part.column("body").to_pylist())
                for form, size in ((TEMPLATE, window), (FOLDED, window), *((VERBATIM, n) for n in (window, *short))):
                    at, hashes = template.windows(size, literals, form)
                    near = known[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                    if near.any():
                        yield _hit_rows(part.select(["doc_id", "text_hash"]), template, at[near], hashes[near], size, form)
                del part, template, at, hashes, near
            del batch
            pa.default_memory_pool().release_unused()
        # the worker outlives the task
        process_state("template_codes", _Codes).clear()
        hand_back()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), text_bytes(text).alias("body"))
    hits = rows.mapInArrow(probe, f"doc_id {kinds[0]}, text_hash bigint, window bigint, at bigint, slots array<string>, form int").drop("form")
    pairs = hits.join(indexed.select("item_id", "window", "form", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")), "window")
    hit = F.struct(F.col("item_at").alias("at"), "form", F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    # per alignment its distinct windows: bounded by the item's words
    aligned = pairs.groupBy("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set(hit).alias("hits"))
    of_form = [F.count_distinct(F.when(F.col("form") == form, F.col("at"))) for form in (TEMPLATE, FOLDED, VERBATIM)]
    sizes = indexed.groupBy("item_id").agg(F.countDistinct("at").alias("item_windows"), *[n.alias(f"_{i}") for i, n in enumerate(of_form)])
    sizes = sizes.select("item_id", "item_windows", F.array("_0", "_1", "_2").alias("sizes"))
    good = (
        aligned.join(sizes, "item_id").withColumn("found", best_run("hits", "sizes", run - window + 1, share, whole_slots))
        .where("found is not null").select("doc_id", "text_hash", "item_id", "item_windows", "found.*")
    )
    best = F.struct("n_windows", "verbatim", "n_slots")
    return (
        good.groupBy("doc_id", "text_hash", "item_id", "item_windows").agg(F.max(best).alias("best"))
        .select("doc_id", "text_hash", "item_id", F.col("best.n_windows").alias("n_windows"), "item_windows", F.col("best.n_slots").alias("n_slots"), F.col("best.verbatim").alias("verbatim"))
    )
