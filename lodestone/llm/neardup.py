"""Near-duplicate records by SetSketch registers.

A record is the set of its tokens. Each of m registers holds the largest of exponentially
spaced, truncated minima: k = max over tokens of floor(1 - log_b h), h exponential with rate a,
clamped to 0..q+1. Two sets share a register value with a probability near their Jaccard
similarity. Bands of registers, the same few for every record at every size of the collection,
bring records together by a shuffle; within a bucket, short or long, all are compared with all
by bits of the registers' values. Candidates that agree in enough bits are estimated jointly, by the likelihood of the numbers of registers that are
greater, equal and smaller given both set sizes, and an exact comparison of the token sets
confirms what the estimate leaves.

Equal texts (in lower case) are one class, known by a hash of the text. Copies therefore
collapse before anything is compared, and links are between classes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, for_workers

#: SetSketch parameters: base, rate and number of register values.
BASE, RATE, Q = 1.001, 20.0, 65_534
#: Registers of a band.
WIDTH = 5
#: Chance that a pair just at the threshold shares no band.
MISS = 0.0016
#: Signature bits: 64 in one word, 56 in another beside the size class.
SIGNATURE_BITS = 120
#: Standard deviations below the threshold at which a signature or an estimate gives a pair up.
SLACK = 3.5
#: Buckets up to this size are compared many at once; longer ones in tiles, ordered by size.
BLOCK = 2_000
#: Rows and columns of a tile.
TILE = (32, 4_096)
#: Size classes of likely pairs differ by no more than this.
APART = 9
#: Rows of a bucket that are held in one task; longer buckets are dealt into blocks of this size.
HELD = 200_000
#: Classes up to this number may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_CLASSES = 500_000
#: Tokens whose registers a worker keeps (2 bytes per register each).
KEPT_TOKENS = 60_000

_TOKEN = re.compile("[a-z0-9]+")


def band_plan(threshold: float) -> tuple[int, int]:
    """Registers per band and bands. The plan depends on the threshold alone, so that what is
    shuffled per record is the same at every size."""
    bands = math.ceil(math.log(MISS) / math.log(1 - threshold**WIDTH))
    return WIDTH, max(bands, math.ceil(SIGNATURE_BITS / WIDTH))


def whole_text(*texts: Column) -> Column:
    """The lower-cased texts joined by a space, null counting as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(t.cast("string"), F.lit("")) for t in texts]))


def token_set(text: Column) -> Column:
    """The distinct runs of a-z0-9 of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), 0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SetSketcher:
    """Register values of token sets; those of single tokens are remembered."""

    def __init__(self, registers: int):
        self.m = registers
        self.seeds = _mix(np.arange(1, registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, self.m), np.uint16)

    def _learn(self, tokens: list[str]) -> None:
        import xxhash

        need = len(self.row) + len(tokens)
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), self.m), np.uint16)
            grown[: len(self.table)] = self.table
            self.table = grown
        for at in range(0, len(tokens), 4096):
            part = tokens[at : at + 4096]
            base = np.array([xxhash.xxh64_intdigest(t) for t in part], np.uint64)
            u = (_mix(base[:, None] ^ self.seeds[None, :]) >> np.uint64(11)).astype(np.float64)
            h = -np.log((u + 0.5) * 2.0**-53) / RATE
            k = np.clip(np.floor(1.0 - np.log(h) / math.log(BASE)), 0, Q + 1).astype(np.uint16)
            first = len(self.row)
            self.table[first : first + len(part)] = k
            for i, t in enumerate(part):
                self.row[t] = first + i

    def registers(self, sets: list[list[str]]) -> np.ndarray:
        """A row of register values per (non-empty) set."""
        out = np.empty((len(sets), self.m), np.uint16)
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= 40_000):
                size += len(sets[end])
                end += 1
            flat = [t for s in sets[at:end] for t in s]
            row = self.row
            if fresh := list({t: None for t in flat if t not in row}):
                if len(row) + len(fresh) > KEPT_TOKENS:
                    self._clear()
                    row = self.row
                    fresh = list(dict.fromkeys(flat))
                self._learn(fresh)
            index = np.fromiter((row[t] for t in flat), np.int64, len(flat))
            starts = np.zeros(end - at, np.int64)
            np.cumsum([len(s) for s in sets[at : end - 1]], out=starts[1:])
            if len(index) > 200_000:  # one very long set: a slice at a time
                best = np.zeros(self.m, np.uint16)
                for i in range(0, len(index), 40_000):
                    np.maximum(best, self.table[index[i : i + 40_000]].max(axis=0), out=best)
                out[at] = best
            else:
                out[at:end] = np.maximum.reduceat(self.table[index], starts, axis=0)
            at = end
        return out


def size_class(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Logarithmic size in steps of which 8 make up the threshold's ratio, at most 255."""
    step = math.log(1 / threshold) / 8
    return np.minimum(255, np.rint(np.log(sizes) / step)).astype(np.uint64)


def signatures(registers: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Two words per record: a mixed bit of each of 64 registers; those of 56 more and, in the
    low byte, the size class."""
    m = registers.shape[1]
    bit = (_mix(registers[:, :SIGNATURE_BITS].astype(np.uint64) + np.uint64(m)) & np.uint64(1)).astype(np.uint8)
    full = np.zeros((len(registers), 16), np.uint8)
    packed = np.packbits(bit, axis=1)
    full[:, : packed.shape[1]] = packed
    words = full.view("<u8")
    return words[:, 0].copy(), (words[:, 1] << np.uint64(8)) | size_class(sizes, threshold)


def most_different(threshold: float, bits: int) -> int:
    """Most differing signature bits that keep a pair. A bit of a register differs with
    probability 1/2 - J/2; the likelihood of J = threshold is given up SLACK standard
    deviations above its expectation."""
    p = 0.5 - threshold / 2
    return math.ceil(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


_BITS = np.uint64(0xFFFFFFFFFFFFFF00)
_BYTE = np.uint64(0xFF)


def _likely(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of rows (i, j) that are likely to be as similar as the threshold. The first
    64 bits rule most of the others out before the rest is looked at."""
    first = np.bitwise_count(x["s1"][i] ^ x["s1"][j])
    keep = np.flatnonzero(first <= most_different(threshold, 64))
    i, j = i[keep], j[keep]
    a, b = x["s2"][i], x["s2"][j]
    differ = first[keep].astype(np.int64) + np.bitwise_count((a ^ b) & _BITS)
    apart = np.abs((a & _BYTE).astype(np.int64) - (b & _BYTE).astype(np.int64))
    keep = (differ <= most_different(threshold, SIGNATURE_BITS)) & (apart <= APART) & (x["cls"][i] != x["cls"][j])
    return i[keep], j[keep]


def _pairs_of_runs(x: dict[str, np.ndarray], starts: np.ndarray, lengths: np.ndarray, threshold: float):
    """Likely pairs (class, class) within runs of rows that share a band."""
    for n in np.unique(lengths[lengths > 1]):
        n = int(n)
        left, right = np.triu_indices(n, 1)
        these = starts[lengths == n]
        at_once = max(1, 2_000_000 // len(left))
        for p in range(0, len(these), at_once):
            base = these[p : p + at_once, None]
            i, j = _likely(x, (base + left).ravel(), (base + right).ravel(), threshold)
            if len(i):
                a, b = x["cls"][i], x["cls"][j]
                yield np.minimum(a, b), np.maximum(a, b)


def _once(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row per class."""
    _, first = np.unique(x["cls"], return_index=True)
    return {c: v[first] for c, v in x.items()}


def _by_size(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.argsort(x["s2"] & _BYTE, kind="stable")
    return {c: v[order] for c, v in x.items()}


def _tiled(x: dict[str, np.ndarray], y: dict[str, np.ndarray] | None, threshold: float):
    """Likely pairs (class, class) of a row of x and one of y, or of two of x: the same that a
    comparison pair by pair finds. Rows are ordered by size class, and those whose classes are
    too far apart are not met."""
    x = _by_size(x)
    other = x if y is None else _by_size(y)
    at, size = ((z["s2"] & _BYTE).astype(np.int64) for z in (x, other))
    begins, ends = np.searchsorted(size, at - APART), np.searchsorted(size, at + APART, side="right")
    both = x if y is None else {c: np.concatenate([x[c], y_c]) for c, y_c in other.items()}
    offset, most = (0 if y is None else len(at)), most_different(threshold, 64)
    rows, columns = TILE
    for top in range(0, len(at), rows):
        left = x["s1"][top : top + rows, None]
        end = ends[min(top + rows, len(at)) - 1]
        for first in range(top if y is None else begins[top], end, columns):
            right = other["s1"][None, first : min(first + columns, end)]
            met = np.flatnonzero(np.bitwise_count(left ^ right) <= most)
            i, j = np.divmod(met, right.shape[1])
            i, j = i + top, j + first
            if y is None:
                i, j = i[i < j], j[i < j]
            i, j = _likely(both, i, j + offset, threshold)
            if len(i):
                a, b = both["cls"][i], both["cls"][j]
                yield np.minimum(a, b), np.maximum(a, b)


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    ks, cls, s1, s3 = (b.column(n).to_numpy(zero_copy_only=False) for n in ("ks", "cls", "s1", "s3"))
    s2 = (ks.view(np.uint64) & np.uint64(0xFFFFFFFF)) | (s3.view(np.uint32).astype(np.uint64) << np.uint64(32))
    return {"k": ks >> 32, "cls": cls, "s1": s1.view(np.uint64), "s2": s2}


_FOUND = "a long, b long, k long, s long"


def _found_batch(a, b, k=None, s=None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    cols = [pa.array(a), pa.array(b), none if k is None else pa.array(k), none if s is None else pa.array(s)]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "k", "s"])


def _unique_pairs(groups) -> Iterator[pa.RecordBatch]:
    """Batches of distinct pairs, of bounded size."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        a, b = np.unique(np.stack([np.concatenate(c) for c in zip(*held)]), axis=1)
        return _found_batch(a, b)

    for g in groups:
        held.append(g)
        size += len(g[0])
        if size > 500_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _compare_sorted(threshold: float):
    """Streams rows sorted by band key. Buckets of up to HELD rows are compared all with all,
    those of more than BLOCK in tiles; the rows of longer ones are passed on, with their key,
    without being gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        hot_key = None

        def flush(x, starts, lengths):
            yield from _unique_pairs(_pairs_of_runs(x, starts, lengths, threshold))

        def long_run(x, s, n):
            once = _once({c: v[s : s + n] for c, v in x.items()})
            if len(once["k"]) > BLOCK:
                yield from _unique_pairs(_tiled(once, None, threshold))
            else:
                yield from flush(once, np.array([0]), np.array([len(once["k"])]))

        def hot_rows(x, start, end):
            part = {c: np.ascontiguousarray(v[start:end]) for c, v in x.items()}
            return _found_batch(part["cls"], part["s1"].view(np.int64), part["k"], part["s2"].view(np.int64))

        for b in batches:
            x = _columns(b)
            if rest is not None:
                x = {c: np.concatenate([rest[c], x[c]]) for c in x}
            k = x["k"]
            if not len(k):
                continue
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            lengths = np.diff(np.r_[starts, len(k)])
            whole = np.ones(len(starts), bool)
            if hot_key is not None and k[0] == hot_key:
                yield hot_rows(x, 0, lengths[0])
                whole[0] = False
            if len(starts) > 1 or whole[0]:
                hot_key = None
                last = starts[-1]
                whole[-1] = False
                for s in np.flatnonzero(whole & (lengths > BLOCK)):
                    yield from long_run(x, starts[s], lengths[s])
                small = whole & (lengths <= BLOCK)
                yield from flush(x, starts[small], lengths[small])
                rest = {c: v[last:].copy() for c, v in x.items()}
                if len(rest["k"]) > HELD:
                    hot_key = rest["k"][0]
                    yield hot_rows(rest, 0, len(rest["k"]))
                    rest = None
            else:
                rest = None
        if rest is not None and len(rest["k"]):
            yield from long_run(rest, 0, len(rest["k"]))

    return run


def _hot_candidates(hot: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs of buckets with more than HELD rows: their rows are dealt into blocks of
    about HELD, and every two blocks meet in a task of their own, where all of one are compared
    with all of the other."""
    rows = hot.select("k", F.col("a").alias("cls"), F.col("b").alias("s1"), F.col("s").alias("s2")).distinct()
    sizes = rows.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "k").withColumn("h", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "k", "cls", "s1", "s2", "h", F.least("h", "j").alias("i"), F.greatest("h", "j").alias("j")
    )

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = {n: t.column(n).to_numpy() for n in ("cls", "s1", "s2", "h", "i", "j")}
        x = _once(x | {"s1": x["s1"].view(np.uint64), "s2": x["s2"].view(np.uint64)})
        one, two = ({c: x[c][x["h"] == x[side]] for c in ("cls", "s1", "s2")} for side in "ij")
        met = _tiled(one, None if (x["i"] == x["j"]).all() else two, threshold)
        found = [b.select(["a", "b"]) for b in _unique_pairs(met)]
        return pa.Table.from_batches(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return met.groupBy("k", "i", "j").applyInArrow(compare, "a long, b long")


# ---------------------------------------------------------------- joint estimate


def _chance(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p_b(x) = -log_b(1 - x (b - 1) / b), the chance of a greater register, and its slope."""
    c = (BASE - 1) / BASE
    inner = 1 - x * c
    return -np.log(inner) / math.log(BASE), c / (inner * math.log(BASE))


def joint_similarity(greater: np.ndarray, equal: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that is likeliest for sets of the given sizes when so many
    registers of the first are greater than, equal to and smaller than those of the second."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    low = np.zeros(len(u))
    high = np.minimum(u, v) / np.maximum(u, v)
    for _ in range(40):  # the likelihood is concave: its slope is bisected
        j = (low + high) / 2
        p, dp = _chance(u - v * j)
        q, dq = _chance(v - u * j)
        tiny = 1e-12
        slope = -greater * v * dp / np.maximum(p, tiny) - smaller * u * dq / np.maximum(q, tiny)
        slope += equal * (v * dp + u * dq) / np.maximum(1 - p - q, tiny)
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def estimate_error(similarity: float, size_a: np.ndarray, size_b: np.ndarray, registers: int) -> np.ndarray:
    """The standard deviation of the estimate, from its Fisher information."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    j = np.minimum(similarity, np.minimum(u, v) / np.maximum(u, v))
    p, dp = _chance(u - v * j)
    q, dq = _chance(v - u * j)
    tiny = 1e-3
    each = (v * dp) ** 2 / np.maximum(p, tiny) + (u * dq) ** 2 / np.maximum(q, tiny) + (v * dp + u * dq) ** 2 / np.maximum(1 - p - q, tiny)
    return 1 / np.sqrt(registers * each)


def estimates(registers_a: np.ndarray, registers_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Joint estimates for rows of registers."""
    greater = (registers_a > registers_b).sum(axis=1)
    equal = (registers_a == registers_b).sum(axis=1)
    return joint_similarity(greater, equal, registers_a.shape[1] - greater - equal, size_a, size_b)


def _confirmed(threshold: float, m: int):
    """A mapInArrow function over pairs with both texts: those whose joint estimate and then
    exact similarity reach the threshold come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = SetSketcher(m)
        for b in batches:
            if not b.num_rows:
                continue
            a_side, b_side = b.column("t_a").to_pylist(), b.column("t_b").to_pylist()
            place = {t: i for i, t in enumerate(dict.fromkeys([*a_side, *b_side]))}
            sets = [set(_TOKEN.findall(t)) for t in place]
            registers = sketcher.registers([list(s) for s in sets])
            sizes = np.array([len(s) for s in sets], np.float64)
            i, j = (np.fromiter((place[t] for t in side), np.int64, len(side)) for side in (a_side, b_side))
            lowest = threshold - SLACK * estimate_error(threshold, sizes[i], sizes[j], m)
            likely = np.flatnonzero(estimates(registers[i], registers[j], sizes[i], sizes[j]) >= lowest)
            keep, similar = [], []
            for k in likely.tolist():
                x, y = sets[i[k]], sets[j[k]]
                n = len(x & y)
                whole = len(x) + len(y) - n
                if n >= whole * threshold - 1e-9:
                    keep.append(k)
                    similar.append(n / whole)
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b"), pa.array(similar, pa.float64())], names=["cls_a", "cls_b", "similarity"])

    return run


@for_workers
def near_duplicates(records: DataFrame, record_id: Column, *texts: Column, threshold: float = 0.75):
    """Classes and links of near-duplicate records.

    Returns (members, links). members: id, cls - the class of each record, texts equal in
    lower case being one class; records without a token and null ids have none. links: cls_a, cls_b,
    similarity - the pairs of different classes whose token sets have a Jaccard similarity of
    at least ``threshold``, cls_a < cls_b, each once. A token is a maximal run of a-z0-9 in
    the lower-cased texts, null counting as empty. Repeated rows count once. Very long texts
    are used whole. Empty tables give empty results. Other columns play no part.

    A pair just at the threshold shares a band with probability 1 - MISS, more similar pairs
    more surely; bands and registers per record are the same whatever the number of records,
    and so are the pairs that are found in a bucket, whatever its length.
    """
    named = (
        records.select(record_id.alias("id"), whole_text(*texts).alias("text"))
        .where(F.col("id").isNotNull() & F.col("text").rlike("[a-z0-9]"))
        .withColumn("cls", F.xxhash64("text"))
    )
    members = named.select("id", "cls").distinct()

    width, bands = band_plan(threshold)
    m = width * bands

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = SetSketcher(m)
        seeds = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for batch in batches:
            cls, first = np.unique(batch.column("cls").to_numpy(), return_index=True)
            texts_once = batch.column("text").take(pa.array(first)).to_pylist()
            sets = [list(set(_TOKEN.findall(t))) for t in texts_once]
            registers = sketcher.registers(sets)
            s1, s2 = signatures(registers, np.array([len(s) for s in sets]), threshold)
            key = np.tile(seeds, (len(sets), 1))
            parts = registers.reshape(len(sets), bands, width).astype(np.uint64)
            for i in range(width):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
            # The band's key, part of the signature and the size class in one word: 28 bytes a row.
            ks = (key & np.uint64(0xFFFFFFFF00000000)) | (s2 & np.uint64(0xFFFFFFFF))[:, None]
            s3 = (s2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
            spread = lambda v: pa.array(np.repeat(v, bands))
            columns = [pa.array(ks.ravel().view(np.int64)), spread(cls), spread(s1.view(np.int64)), spread(s3)]
            yield pa.RecordBatch.from_arrays(columns, names=["ks", "cls", "s1", "s3"])

    banded = named.select("cls", "text").mapInArrow(sketch, "ks long, cls long, s1 long, s3 int")
    met = banded.repartition(F.shiftright("ks", 32)).sortWithinPartitions("ks")
    found = cut(met.mapInArrow(_compare_sorted(threshold), _FOUND))
    pairs = found.where("k IS NULL").select("a", "b")
    hot = found.where("k IS NOT NULL")
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_candidates(hot, threshold))
    pairs = cut(pairs.distinct())

    wanted = cut(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
    few = wanted.count() <= BROADCAST_CLASSES

    # Texts of the wanted classes alone are gathered.
    texts_of = named.select("cls", "text").join(F.broadcast(wanted) if few else wanted, "cls", "left_semi")
    once = texts_of.groupBy("cls").agg(F.first("text").alias("text"))
    side = lambda c: once.select(F.col("cls").alias(c), F.col("text").alias(f"t_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")
    links = both.mapInArrow(_confirmed(threshold, m), "cls_a long, cls_b long, similarity double")
    return members, links


def expanded_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a, id_b: every pair of different records that are linked or of one class, smaller first."""
    several = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    ends = links.select(F.col("cls_a").alias("cls")).unionByName(links.select(F.col("cls_b").alias("cls")))
    several = cut(several)
    # Only members of classes with a partner or a second member go on.
    needed = cut(members.join(ends.unionByName(several).distinct(), "cls", "left_semi"))
    ma = needed.select(F.col("cls").alias("cls_a"), F.col("id").alias("x"))
    mb = needed.select(F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    across = links.select("cls_a", "cls_b").join(ma, "cls_a").join(mb, "cls_b").select("x", "y").where("x <> y")
    own = needed.join(several, "cls", "left_semi")
    within = own.select("cls", F.col("id").alias("x")).join(own.select("cls", F.col("id").alias("y")), "cls").where("x < y")
    pairs = across.unionByName(within.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
