"""Benchmark decontamination by template canonicalisation.

Words become tokens without the punctuation around them, in lower case. Numbers
(in digits or number words), numbers with a unit attached, units after a number,
and capitalised words within a sentence become typed placeholders; the rest stands
for itself. Windows of WINDOW tokens of the canonical text are hashed, and the
windows of documents are hash-joined with those of the benchmark. A Bloom filter
of the benchmark's windows, whose size is bounded by MAX_FILTER_BITS, keeps the
other windows of documents from the shuffle.

The matches of a document and an item along one diagonal are one copy. A copy
counts if its slots are consistent: a value of the item's slots is always replaced
by the same value of the document. An item is in a document if consistent copies
cover MIN_COVERAGE of its tokens; `exact` tells whether no slot was changed.

Templates with fewer than LITERALS of their tokens standing for themselves are left
out, as they fit anything. Beside them the windows of the tokens themselves, in lower
case, are joined at all positions, so that word-for-word copies are found however
many slots they have and whatever their case: all in capitals, in title case or without
any. Where the slots of a copy are not consistent, its unchanged windows still count.
Number and unit words are those of English, German, French and Spanish; words that are
common in another sense in one of these (`once`, `elf`, `seize`, articles) are left out.

An item shorter than a window is one window as long as itself; if it begins with a
capital, it has that window with its first word as a name, too, as a document may not
end a sentence before it. An item of fewer than
MIN_TOKENS tokens can not be searched for and matches nothing; so do null and empty
texts. Repeated documents of one id count together; repeated items of one id, too.
Null ids are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.llm.common import CACHED_WORD_CHARS, CACHE_ENTRIES, keeps, lean, materialise, mix64, slices, window_hashes

WINDOW, MIN_TOKENS = 8, 4
LITERALS = 0.6
MIN_COVERAGE = 0.6
#: Bits of the Bloom filter for each benchmark window, and of the whole at most.
FILTER_BITS, MAX_FILTER_BITS = 64, 1 << 27

# Number words and common units of measure.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null zwei drei vier fünf sechs sieben acht neun zehn zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million milliarde "
    "zéro deux trois quatre cinq huit neuf dix onze douze treize quatorze quinze vingt trente quarante cinquante soixante cent mille milliard "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil millón".split()
)
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph hz khz mhz ghz b kb mb gb tb w kw kwh v a c f k j kj cal kcal pa kpa "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms degree degrees percent dollar dollars cent cents euro euros usd eur gbp "
    "stunde stunden minute minuten sekunde sekunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren gramm kilogramm pfund meile meilen grad prozent "
    "heure heures seconde secondes jour jours semaine semaines mois année années kilogramme kilogrammes grammes mètre mètres livre livres litres kilomètre kilomètres degrés "
    "hora horas minuto minutos segundo segundos día días semana semanas mes meses año años gramo gramos kilo kilos metro metros libra libras litro litros kilómetro kilómetros grados dólares céntimos".split()
)

_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_NUMBER = re.compile(r"\d[\d.,:/]*")
_WITH_UNIT = re.compile(r"\d[\d.,:/]*[^\W\d]{1,6}\Z")
_CAP, _NUM, _UNIT, _ENDS, _BOTH = 1, 2, 4, 8, 16
_FLAG_BITS = 6
_NUMBER_SLOT, _BOTH_SLOT, _UNIT_SLOT, _NAME_SLOT = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("<number>", "<number unit>", "<unit>", "<name>"))


class _Words(dict):
    """word -> 57-bit hash of its core and flags; 0 (or the end of a sentence alone) for punctuation."""

    def __missing__(self, word: str) -> int:
        value = self.plain(word) if word.isalpha() else self.plain(word[:-1], word[-1]) if word[:-1].isalpha() and word[-1] in ",.!?:;" else self.any(word)
        if len(word) <= CACHED_WORD_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value

    @staticmethod
    def plain(core: str, after: str = ",") -> int:
        """Of letters alone, with at most one sign after them: any() without its searches."""
        low = core.lower()
        flags = 0 if after == "," else _ENDS
        if low in NUMBER_WORDS:
            flags |= _NUM
        else:
            flags |= (_UNIT if low in UNITS else 0) | (_CAP if core[0].isupper() else 0)
        return (xxhash.xxh3_64_intdigest(low) >> 7 | 1) << _FLAG_BITS | flags

    @staticmethod
    def any(word: str) -> int:
        found = _CORE.search(word)
        flags = _ENDS if word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", ";", "…", "。") else 0
        value = flags
        if found:
            core = found[0]
            low = core.lower()
            sign = set(word[: found.start()] + word[found.end() :]) & set("$€£¥%°")
            if _NUMBER.fullmatch(core):
                flags |= _BOTH if sign else _NUM
            elif low in NUMBER_WORDS:
                flags |= _NUM
            elif _WITH_UNIT.match(core):
                flags |= _BOTH
            elif low in UNITS:
                flags |= _UNIT | (_CAP if core[0].isupper() else 0)
            elif core[0].isupper():
                flags |= _CAP
            value = (xxhash.xxh3_64_intdigest(low) >> 7 | 1) << _FLAG_BITS | flags
        return value


_WORDS = _Words()
keeps(__name__, _WORDS.clear)


def canonical(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of all texts: text number, canonical code, own code, and whether it is a slot."""
    return tokens(texts)[:4]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What canonical() gives, and flags."""
    words = [(t or "").split() for t in texts]
    sizes = [len(w) for w in words]
    packed = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=sum(sizes))
    owner = np.repeat(np.arange(len(texts)), sizes)
    flags = (packed & np.uint64((1 << _FLAG_BITS) - 1)).astype(np.uint8)
    first = np.ones(len(owner), dtype=bool)
    if len(owner):
        first[1:] = (owner[1:] != owner[:-1]) | (flags[:-1] & _ENDS > 0)
        # Punctuation alone passes on whether a sentence starts after it.
        blank = packed < 1 << _FLAG_BITS
        if blank.any():
            at = np.flatnonzero(~blank)
            starts = np.cumsum(first | (blank & (flags & _ENDS > 0)))
            kept = np.zeros(len(at), dtype=bool)
            kept[0:1] = True
            kept[1:] = (starts[at[1:]] > starts[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
            owner, packed, flags, first = owner[at], packed[at], flags[at], kept
    own = packed >> np.uint64(_FLAG_BITS)
    code = own.copy()
    number, both = flags & _NUM > 0, flags & _BOTH > 0
    unit = np.zeros(len(own), dtype=bool)
    if len(own):
        unit[1:] = (flags[1:] & _UNIT > 0) & number[:-1] & (owner[1:] == owner[:-1])
    name = (flags & _CAP > 0) & ~first & ~unit
    for mask, slot in ((number, _NUMBER_SLOT), (both, _BOTH_SLOT), (unit, _UNIT_SLOT), (name, _NAME_SLOT)):
        code[mask] = slot
    return owner, code, own, number | both | unit | name, flags


def windows(owner: np.ndarray, code: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where usable windows of `size` tokens of one text begin, and their hashes."""
    hashes = window_hashes(code, size)
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.intp), hashes
    slots = np.concatenate(([0], np.cumsum(slot)))
    usable = (owner[:n] == owner[size - 1 :]) & (slots[size:] - slots[:-size] <= size - np.ceil(LITERALS * size))
    at = np.flatnonzero(usable)
    return at, mix64(hashes[at] + np.uint64(size))


def verbatim(owner: np.ndarray, own: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows with slots begin, and the hashes of their tokens themselves, in lower case.

    A window without slots is its own template: windows() gives it the same hash.
    """
    n = len(own) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.intp), np.empty(0, dtype=np.uint64)
    slots = np.concatenate(([0], np.cumsum(slot)))
    at = np.flatnonzero((owner[:n] == owner[size - 1 :]) & (slots[size:] > slots[:-size]))
    return at, mix64(window_hashes(own, size)[at] + np.uint64(size))


def _as_name(found: tuple[np.ndarray, np.ndarray], renamed: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows those that are a whole item and begin with a word that was made a name."""
    at, hashes = found
    keep = renamed[at] & whole[at]
    return at[keep], hashes[keep]


def _rows(ids: list, texts: list[str | None], sizes: list[int] | None, bloom: np.ndarray | None) -> tuple[list, ...]:
    """hash, id, position, size, values, tokens of the windows of texts that pass the filter.

    sizes: None for items, whose windows are as long as they can be. The values of an
    item are those of its slots; a document has the values of all tokens where a window
    of it stands for itself.
    """
    owner, code, own, slot, flags = tokens(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.empty(0, dtype=np.int64)
    starts = np.cumsum(counts) - counts
    out: tuple[list, ...] = ([], [], [], [], [], [])
    if sizes is None:
        named = slot.copy()
        begins = starts[counts > 0]
        named[begins] |= flags[begins] & _CAP > 0
        renamed = np.where(named & ~slot, _NAME_SLOT, code)
    for size in sizes if sizes is not None else range(MIN_TOKENS, WINDOW + 1):
        kinds = [(slot, windows(owner, code, slot, size)), (slot, verbatim(owner, own, slot, size))]
        if sizes is None:
            kinds.append((named, _as_name(windows(owner, renamed, named, size), named & ~slot, counts[owner] == size)))
        for itself, (slots, (at, hashes)) in enumerate(kinds):
            if sizes is None and size < WINDOW:
                keep = counts[owner[at]] == size
                at, hashes = at[keep], hashes[keep]
            if bloom is not None and len(at):
                keep = passes(bloom, hashes)
                at, hashes = at[keep], hashes[keep]
            own_at = owner[at]
            for h, p, o in zip(hashes.view(np.int64).tolist(), at.tolist(), own_at.tolist(), strict=True):
                out[0].append(h), out[1].append(ids[o]), out[2].append(p - int(starts[o])), out[3].append(size)
                values, filled = own[p : p + size], slots[p : p + size]
                every = sizes is not None and (itself or not filled.any())
                out[4].append((values if every else np.where(filled, values, np.uint64(0))).astype(np.int64))
                out[5].append(int(counts[o]))
    return out


def passes(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(bloom) * 8 - 1)
    found = np.ones(len(hashes), dtype=bool)
    for shift in (0, 32):
        bit = hashes >> np.uint64(shift) & bits if shift == 0 else mix64(hashes) & bits
        found &= bloom[(bit >> np.uint64(3)).astype(np.intp)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0
    return found


def _emit(id_name: str, sizes: list[int] | None, bloom: bytes | None):
    names = ["hash", id_name, "pos", "size", "slots", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bloom, dtype=np.uint8) if bloom is not None else None
        for batch in batches:
            for ids, texts in slices(batch):
                found = _rows(ids, texts, sizes, table)
                if found[0]:
                    ends = np.cumsum([0, *map(len, found[4])])
                    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found[4]), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in found[:4]), values, pa.array(found[5], pa.int64())], names)

    return run, f"hash long, {id_name} long, pos long, size long, slots array<long>, tokens long"


def bloom_filter(hashes: DataFrame) -> bytes:
    """Bits of the distinct hashes, gathered by words so that its bound is the filter's own size."""
    n = hashes.count()
    bits = 1 << 16
    while bits < min(MAX_FILTER_BITS, n * FILTER_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bit = np.unique(np.concatenate([h & np.uint64(bits - 1), mix64(h) & np.uint64(bits - 1)]))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(3)).astype(np.int64)), pa.array((1 << (bit & np.uint64(7)).astype(np.int64)), pa.int64())], ["at", "bit"])

    table = np.zeros(bits // 8, dtype=np.uint8)
    filled = hashes.mapInArrow(lean(run), "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table[filled["at"].to_numpy()] = filled["bits"].to_numpy()
    return table.tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, copies, exact of every item that is in a document."""
    run, kind = _emit("item_id", None, None)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    items = materialise(items.mapInArrow(lean(run), kind))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # WINDOW - MIN_TOKENS + 1 at most
    run, kind = _emit("doc_id", sizes, bloom_filter(items.select("hash").distinct()))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = given.mapInArrow(lean(run), kind).selectExpr("hash", "doc_id", "pos AS doc_pos", "size", "slots AS doc_slots")
    both = found.join(items.select("hash", "item_id", "pos", "size", "slots", "tokens"), ["hash", "size"])
    pairs = F.filter(F.arrays_zip(F.col("slots").alias("item"), F.col("doc_slots").alias("doc")), lambda x: x["item"] != 0)
    # A copy has each position of the item once, repeated rows of a document give it again: sets are bounded by the item and its values.
    copies = both.groupBy("doc_id", "item_id", "tokens", (F.col("doc_pos") - F.col("pos")).alias("diagonal")).agg(
        F.collect_set(F.struct("pos", "size", F.forall(pairs, lambda x: x["item"] == x["doc"]).alias("same"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["item"])))
    counted = F.filter("spans", lambda x: consistent | x["same"])
    copies = copies.withColumn("spans", F.array_distinct(F.transform(counted, lambda x: F.struct(x["pos"].alias("pos"), x["size"].alias("size"))))).filter(F.size("spans") > 0)
    # Of an item's spans each is kept once, so that a document full of copies of it stays small.
    spans = copies.select("doc_id", "item_id", "tokens", "diagonal", F.forall("pairs", lambda x: x["item"] == x["doc"]).alias("exact"), F.explode("spans").alias("span"))
    spans = spans.groupBy("doc_id", "item_id", "tokens", "span").agg(F.max("exact").alias("exact"), F.count(F.lit(1)).alias("times"))
    whole = spans.groupBy("doc_id", "item_id", "tokens").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.min("exact").alias("exact"), F.max("times").alias("copies"))
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct((s["covered"] + x["pos"] + x["size"] - F.greatest(s["end"], x["pos"])).alias("covered"), (x["pos"] + x["size"]).alias("end")),
        lambda s: s["covered"],
    )
    whole = whole.withColumn("coverage", covered / F.col("tokens")).filter(F.col("coverage") >= MIN_COVERAGE)
    return whole.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("copies").alias("copies"), F.max("exact").alias("exact"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item of the benchmark was found; rows without an id stay."""
    return docs.join(materialise(leaks(docs, benchmark).select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
