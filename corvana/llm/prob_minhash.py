"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A document is the multiset of its five-word shingles, weighted by their counts.
Every shingle starts a Poisson process whose rate is its weight; an arrival falls
on one of M registers, and a register keeps the shingle of its earliest arrival.
A shingle is dropped as soon as its next arrival is later than all registers.
Two documents agree in a register with the probability Jaccard similarity of
their normalised weights. Bands of registers give candidates, and the exact
probability Jaccard of the candidates' shingles decides.

Texts that are byte for byte equal form one class beforehand and take part once.
Candidates come from buckets without emitting the pairs of a group. Each bucket
first links its smallest member to the others. Once components are known, only
members outside a bucket's largest component are held against the members of other
components, in blocks of bounded size: first by their registers, which passes on rows
and not pairs, then exactly, which gives back links alone. Each pair of a bucket that
could still join two components is compared once, in the first bucket that the two
share. Buckets with very many such members are dealt anew by further registers
before that, so that the number of blocks stays in proportion to the members.

Defined cases: a null text is a class of its own; empty texts (and texts equal
in any way) are copies; a text of fewer than five words is one shingle of all its
words; a text without a word but with other characters is only equal to its
copies. Ids are expected to be unique; repeated rows of an id count once. A null
id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.llm.common import WordCodes, keeps, lean, materialise, mix64, window_hashes, word_codes

REGISTERS = 128
BANDS, ROWS = 25, 5
SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
#: Share of equal registers, below which a pair is taken to be under MIN_SIMILARITY
#: (five standard errors below it).
MIN_AGREEMENT = 0.62
#: A block: members outside the largest component and their shingles, and members that pass by.
OUTSIDE_ROWS, OUTSIDE_SHINGLES, INSIDE_ROWS = 512, 1 << 19, 512
#: Buckets with more members outside their largest component are dealt anew, by runs of so many registers.
CROWDED, FINER_ROWS = 8192, 4
#: Equal shingles that are counted in one numpy pass.
MATCHES = 1 << 20
#: Pairs that a task compares at least: by registers, and by texts.
TASK_PAIRS, TASK_TEXTS = 50_000, 4_000

_WORDS: WordCodes = WordCodes()
keeps(__name__, _WORDS.clear)


def shingles(text: str, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    codes = word_codes(text, _WORDS)
    if 0 < len(codes) < size:
        hashes = window_hashes(codes, len(codes))
    else:
        hashes = window_hashes(codes, size)
    if not len(hashes):
        return hashes, np.empty(0)
    hashes.sort()
    first = np.empty(len(hashes), dtype=bool)
    first[0] = True
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return hashes[at], np.diff(np.append(at, len(hashes))).astype(np.float64)


def signature(hashes: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in each register, from exponential waiting times."""
    earliest = np.full(registers, np.inf)
    winner = np.zeros(registers, dtype=np.uint64)
    live, rate, now, turn = hashes, weights, np.zeros(len(hashes)), 0
    while len(live):
        per = max(1, -(-2 * registers // len(live)))
        steps = np.arange(turn, turn + per, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        turn += per
        random = mix64(live[:, None] + steps[None, :])
        register = (random & np.uint64(registers - 1)).astype(np.intp)
        wait = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        arrival = now[:, None] + np.cumsum(wait, axis=1) / rate[:, None]
        latest = earliest.max()
        flat = arrival.ravel()
        keep = np.flatnonzero(flat < latest) if np.isfinite(latest) else np.arange(len(flat))
        if len(keep):
            reg, when = register.ravel()[keep], flat[keep]
            np.minimum.at(earliest, reg, when)
            won = when == earliest[reg]
            winner[reg[won]] = live[keep[won] // per]
        still = arrival[:, -1] < earliest.max()
        live, rate, now = live[still], rate[still], arrival[still, -1]
    return winner


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band of registers."""
    out = np.arange(n_bands, dtype=np.uint64)
    for k in range(rows):
        out = out * np.uint64(0x9E3779B97F4A7C15) + sig[k : n_bands * rows : rows]
    return mix64(out).view(np.int64)


def probability_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets given by ascending hashes."""
    common, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    total1, total2 = w1.sum(), w2.sum()
    a, b = w1[i] / total1, w2[j] / total2
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    ratio = a / b
    # Elements of the first document alone have an infinite ratio, those of the second alone 0.
    from_a = np.cumsum(a[::-1])[::-1] + (1.0 - a.sum())
    before_b = np.cumsum(b) - b + (1.0 - b.sum())
    first = np.searchsorted(ratio, ratio, side="left")
    return float(np.sum(1.0 / (from_a[first] / a + before_b[first] / b)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, high, low, sizes, keys, sigs = [], [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            digest = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
            ids.append(doc)
            high.append((digest >> 64) - (1 << 63))
            low.append((digest & (1 << 64) - 1) - (1 << 63))
            h, w = shingles(text)
            sizes.append(len(h))
            sig = signature(h, w)
            keys.append(bands(sig) if len(h) else np.empty(0, dtype=np.int64))
            sigs.append(sig.astype(np.uint8).tobytes())
        ends = np.cumsum([0, *map(len, keys)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64())), pa.array(sigs, pa.binary())],
            ["doc_id", "h1", "h2", "n", "bands", "sig"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        a, b, sim = [], [], []
        for x, y, tx, ty in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last[0] != x:
                last = x, shingles(tx)
            s = probability_jaccard(*last[1], *shingles(ty))
            if s >= MIN_SIMILARITY - 1e-9:
                a.append(x), b.append(y), sim.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "sim"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both signatures (a, b, sa, sb) those that agree in enough registers."""
    for batch in batches:
        sides = [np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for n in ("sa", "sb")]
        keep = pa.array((sides[0] == sides[1]).mean(axis=1) >= MIN_AGREEMENT)
        yield pa.RecordBatch.from_arrays([batch.column(n).filter(keep) for n in ("a", "b")], ["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(block, whether its rows ask, rows): the rows of a block (key, c, m) follow one another, those that ask first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "c", "m", "asks")]
        new = np.zeros(batch.num_rows, dtype=bool)
        for x in parts:
            new[1:] |= x[1:] != x[:-1]
        at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            yield (int(parts[0][a]), int(parts[1][a]), int(parts[2][a])), bool(parts[3][a]), batch.slice(a, b - a)


class _Side:
    """The rows of a block that ask: held while the others pass by."""

    def __init__(self, block: tuple) -> None:
        self.block, self.batches, self.rows = block, [], 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.batches.append(rows)

    def settle(self) -> None:
        """Arrays of what was added; rows that ask have all come."""
        if self.rows or not self.batches:
            return
        whole = pa.Table.from_batches(self.batches).combine_chunks()
        self.batches, self.rows = [], whole.num_rows
        self.table, self.sig = whole, _registers(whole)
        self.id, self.label = whole["id"].to_numpy(), whole["label"].to_numpy()
        self.sets: list | None = None

    def index(self) -> None:
        """Shingles of all rows in one ascending array, with their rows."""
        self.sets = [shingles(t) for t in self.table["text"].to_pylist()]
        sizes = np.array([len(h) for h, _ in self.sets])
        every = np.concatenate([h for h, _ in self.sets])
        order = np.argsort(every, kind="stable")
        self.sizes, self.every, self.owner = sizes, every[order], np.repeat(np.arange(self.rows), sizes)[order]
        self.even = np.array([_even(w) for _, w in self.sets])

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        """How many of ascending hashes each row has, MATCHES at a time."""
        low, n = np.searchsorted(self.every, hashes, "left"), np.searchsorted(self.every, hashes, "right")
        n -= low
        low, n = low[n > 0], n[n > 0]
        out, ends = np.zeros(self.rows, dtype=np.int64), np.cumsum(n)
        a = 0
        while a < len(n):
            done = ends[a] - n[a]
            b = max(a + 1, int(np.searchsorted(ends, done + MATCHES, "right")))
            part = n[a:b]
            at = np.repeat(low[a:b] - (ends[a:b] - part - done), part) + np.arange(ends[b - 1] - done)
            out += np.bincount(self.owner[at], minlength=self.rows)
            a = b
        return out


def _registers(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sig"].to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)


def _even(weights: np.ndarray) -> bool:
    """Whether all shingles weigh the same: probability Jaccard is then the Jaccard similarity of the sets."""
    return len(weights) > 0 and weights.min() == weights.max()


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks that agree with some row of the other side in enough registers."""
    names = ["key", "c", "m", "id", "label", "asks", "outside"]
    side, hit = _Side(()), np.empty(0, dtype=bool)

    def asking() -> Iterator[pa.RecordBatch]:
        if hit.any():
            yield from side.table.select(names).filter(pa.array(hit)).combine_chunks().to_batches()

    for block, asks, rows in _runs(batches):
        if block != side.block:
            yield from asking()
            side, hit = _Side(block), np.empty(0, dtype=bool)
        if asks:
            side.add(rows)
            continue
        side.settle()
        if not side.rows:
            continue
        if not len(hit):
            hit = np.zeros(side.rows, dtype=bool)
        sig, label = _registers(rows), rows["label"].to_numpy(zero_copy_only=False)
        keep = np.zeros(rows.num_rows, dtype=bool)
        for k in range(rows.num_rows):
            close = ((side.sig == sig[k]).mean(axis=1) >= MIN_AGREEMENT) & (side.label != label[k])
            keep[k] = close.any()
            hit |= close
        if keep.any():
            yield rows.select(names).filter(pa.array(keep))
    yield from asking()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the components of the two sides of each block, enough to connect what belongs together.

    The side that asks is held, bounded in rows and shingles; the other passes by in
    batches that are bounded in bytes, and its texts are cut only where registers agree.
    """
    side, root = _Side(()), {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for block, asks, rows in _runs(batches):
        if block != side.block:
            side, root = _Side(block), {}
        if asks:
            side.add(rows)
            continue
        side.settle()
        if not side.rows:
            continue
        sig, ids, labels, texts = _registers(rows), rows["id"].to_pylist(), rows["label"].to_pylist(), rows["text"]
        outside, firsts, out = rows["outside"].to_pylist(), rows["bands"].to_pylist(), []
        mine = np.array(side.table["bands"].to_pylist(), dtype=np.int64).reshape(side.rows, -1)
        for k in range(rows.num_rows):
            ask = ((side.sig == sig[k]).mean(axis=1) >= MIN_AGREEMENT) & (side.label != labels[k])
            if outside[k]:  # two members outside meet twice: the smaller id asks
                ask &= side.id < ids[k]
            if mine.shape[1] and ask.any():  # a pair is settled in its first common bucket
                same = mine == np.array(firsts[k], dtype=np.int64)
                ask &= mine[np.arange(side.rows), same.argmax(axis=1)] == block[0]
            ask = [i for i in np.flatnonzero(ask).tolist() if top(int(side.label[i])) != top(labels[k])]
            if not ask:
                continue
            if side.sets is None:
                side.index()
            h, w = shingles(texts[k].as_py())
            common = side.shared(h) if _even(w) else None
            for i in ask:
                if common is not None and side.even[i]:
                    s = common[i] / (len(h) + side.sizes[i] - common[i])
                    if s < MIN_SIMILARITY - 1e-6:
                        continue
                if top(int(side.label[i])) == top(labels[k]):
                    continue
                s = probability_jaccard(*side.sets[i], h, w)
                if s >= MIN_SIMILARITY - 1e-9:
                    root[top(int(side.label[i]))] = top(labels[k])
                    out.append((int(side.label[i]), labels[k], s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "sim"])


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, n) for each run of FINER_ROWS registers outside a bucket's own band: the members of crowded buckets, dealt anew."""
    for batch in batches:
        sig, bands_of = _registers(batch), np.array(batch["bands"].to_pylist(), dtype=np.int64).reshape(batch.num_rows, -1)
        key = batch["key"].to_numpy(zero_copy_only=False)
        band = (bands_of == key[:, None]).argmax(axis=1)
        place = np.arange(REGISTERS)
        for b in np.unique(band).tolist():
            at = np.flatnonzero(band == b)
            free = place[(place < b * ROWS) | (place >= (b + 1) * ROWS)]
            tables = len(free) // FINER_ROWS
            part = sig[at][:, free[: tables * FINER_ROWS]].reshape(len(at), tables, FINER_ROWS).astype(np.uint64)
            code = (key[at].view(np.uint64)[:, None] + np.arange(1, tables + 1, dtype=np.uint64)[None, :]) * np.uint64(0x9E3779B97F4A7C15)
            for r in range(FINER_ROWS):
                code = mix64(code + part[:, :, r])
            rows = np.repeat(at, tables)
            yield pa.RecordBatch.from_arrays([pa.array(code.ravel().view(np.int64)), batch["id"].take(pa.array(rows)), batch["n"].take(pa.array(rows))], ["key", "id", "n"])


def _tasks(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def _headed(keyed: DataFrame, rows: int) -> DataFrame:
    """key, head, id, n of the members (key, id, n) of buckets of more than one; the head is the smallest id. rows: at most so many members."""
    shared = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("head")).filter("size > 1").drop("size"), rows)
    return materialise(keyed.join(shared, "key").select("key", "head", "id", "n"), rows)


def head_links(buckets: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links of each bucket's head with its other members: by registers first, then exactly."""
    pairs = buckets.filter("id != head").selectExpr("head AS a", "id AS b").distinct()
    signed = pairs.join(bodies.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").join(bodies.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    close = materialise(signed.select("a", "b", "sa", "sb").coalesce(_tasks(buckets.count(), TASK_PAIRS)).mapInArrow(lean(_close), "a long, b long"))
    with_text = close.join(bodies.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(bodies.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return materialise(with_text.coalesce(_tasks(close.count(), TASK_TEXTS)).mapInArrow(lean(_verify), "a long, b long, sim double"))


def _mixed(buckets: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, id, n, label) and the buckets that hold several components: main, members and shingles outside it, members."""
    size = buckets.count()
    placed = materialise(buckets.join(label, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label")), size)
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    biggest = F.max(F.struct("r", "label", "n"))
    main = sizes.groupBy("key").agg(biggest.alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("r").alias("all"), F.sum("n").alias("every"))
    # In a bucket of two its head was held against the other member.
    main = main.filter("parts > 1 AND all > 2").selectExpr("key", "m.label AS main", "all - m.r AS out", "every - m.n AS out_n", "all")
    return placed, materialise(main, size)


def block_links(placed: DataFrame, main: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links of components within buckets, from members outside the main one and all others, in bounded blocks."""
    mixed = placed.join(main, "key").withColumn("outside", F.col("label") != F.col("main"))
    hashed, parts = F.xxhash64("id"), F.ceil(F.col("all") / INSIDE_ROWS)
    chunks = F.greatest(F.ceil(F.col("out") / OUTSIDE_ROWS), F.ceil(F.col("out_n") / OUTSIDE_SHINGLES), F.lit(1).cast("long"))
    asking = mixed.filter("outside").withColumn("c", F.pmod(hashed, chunks)).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn("asks", F.lit(True))
    asked = mixed.withColumn("m", F.pmod(hashed, parts)).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).withColumn("asks", F.lit(False))
    columns = ["key", "c", "m", "id", "label", "asks", "outside"]
    rows = asking.select(columns).union(asked.select(columns))
    order = ["key", "c", "m", F.desc("asks")]
    kind = "key long, c long, m long, id long, label long, asks boolean, outside boolean"
    signed = rows.join(bodies.select("id", "sig"), "id").select(*columns, "sig").repartition("key", "c", "m").sortWithinPartitions(*order)
    close = materialise(signed.mapInArrow(lean(_agreeing), kind))
    exact = close.join(bodies.select("id", "sig", "bands", "text"), "id").repartition("key", "c", "m").sortWithinPartitions(*order)
    return materialise(exact.mapInArrow(lean(_linked), "a long, b long, sim double"))


def with_cross_links(buckets: DataFrame, label: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, label) once the components of label are joined that members of one bucket link.

    Buckets with up to CROWDED members outside their main component go through blocks,
    so that a member is in at most 2 * CROWDED / OUTSIDE_ROWS of a bucket's blocks or so. Members
    of more crowded buckets are dealt anew by runs of further registers: a pair at
    MIN_SIMILARITY shares one of these with a probability of 1 - 2e-7. The finer buckets
    are linked by their heads in turn, and only what these leave apart goes through blocks.
    """
    placed, main = _mixed(buckets, label)
    label = merged(label, block_links(placed, main.filter(F.col("out") <= CROWDED), bodies))
    crowded = main.filter(F.col("out") > CROWDED)
    if crowded.isEmpty():
        return label
    members = placed.join(crowded.select("key"), "key", "left_semi").join(bodies.select("id", "sig", "bands"), "id").select("key", "id", "n", "sig", "bands")
    dealt = materialise(members.mapInArrow(lean(_refine), "key long, id long, n long"))
    finer = _headed(dealt, dealt.count())
    heads, own = head_links(finer, bodies), lambda side: label.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
    named = heads.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    label = merged(label, named)
    # The finer keys are no bands: a pair may meet in several of them.
    placed, main = _mixed(finer, label)
    return merged(label, block_links(placed, main, bodies.withColumn("bands", F.array().cast("array<long>"))))


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) of components that links (a, b: labels, or ids without one) join further."""
    further = components(links)
    size = label.count() + further.count()
    moved = label.join(further.toDF("label", "_to"), "label", "left").select("id", F.coalesce("_to", "label").alias("label"))
    return materialise(moved.union(further.join(label, "id", "left_anti").select("id", "label")), size)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each id's connected component.

    Large-star and small-star steps in turn, written out after each round, until no
    edge changes. Each is a hash aggregation, then a join of the edges with its
    written result, which Spark broadcasts where its size allows and else deals out
    with hubs split; a hub's edges are never gathered.
    """
    size, before = 2 * edges.count(), None  # no step makes more rows
    now = materialise(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u != v").distinct(), size)
    while True:
        # Large star: a node's larger neighbours move to the smallest of its neighbourhood.
        both = now.union(now.selectExpr("v AS u", "u AS v"))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(m, u) AS m"), size)
        large = materialise(both.join(least, "u").filter("v > u").selectExpr("v AS u", "m AS v").distinct(), size)
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), size)
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").filter("u != v").union(least.selectExpr("u", "m AS v"))
        now = materialise(small.distinct(), size)
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if state == before:
            break
        before = state
    labelled = now.selectExpr("u AS id", "v AS label")
    return materialise(labelled.union(labelled.selectExpr("label AS id", "label").distinct()), size)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), text_id (smallest doc_id with that very text)."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    sketched = materialise(given.filter("text IS NOT NULL").mapInArrow(lean(_sketch), "doc_id long, h1 long, h2 long, n long, bands array<long>, sig binary"))
    size = sketched.count()
    firsts = materialise(sketched.groupBy("h1", "h2").agg(F.min("doc_id").alias("text_id")), size)
    copies = materialise(sketched.select("doc_id", "h1", "h2").join(firsts, ["h1", "h2"]).select("doc_id", "text_id"), size)
    # Read three times below: written once, so that rows of one id are put together once.
    texts = materialise(sketched.join(copies.filter("doc_id != text_id").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "n", "bands", "sig").dropDuplicates(["id"]))
    buckets = _headed(texts.select("id", "n", F.explode("bands").alias("key")), BANDS * size)
    involved = materialise(buckets.select("id").distinct(), size)
    # One row for each text that has a candidate: all that the comparisons read.
    once = given.filter("text IS NOT NULL").withColumnRenamed("doc_id", "id").join(involved, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    bodies = materialise(once.join(texts.join(involved, "id", "left_semi").select("id", "bands", "sig"), "id"))
    label = with_cross_links(buckets, components(head_links(buckets, bodies)), bodies)
    classes = copies.join(label.withColumnRenamed("id", "text_id"), "text_id", "left").select("doc_id", F.coalesce("label", "text_id").alias("class_id"), "text_id")
    alone = given.filter("text IS NULL").selectExpr("doc_id", "doc_id AS class_id", "doc_id AS text_id")
    return classes.union(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("text_id").alias("text_id"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its class; rows without an id stay."""
    # Written first: where the ids are few, Spark then need not deal the texts out to leave them out.
    others = near_duplicate_classes(docs).filter("doc_id != class_id").select("doc_id")
    others = materialise(others, docs.count())
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
