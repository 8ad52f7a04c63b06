"""BM25 over words and phrases."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.session import cut, for_workers, written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Search units of the queries that are answered by one pass over the texts.
UNITS_PER_PASS, UNITS_PER_PASS_AND = 4_000_000, 100_000
#: Texts that a worker indexes at once.
TEXTS_AT_ONCE = 65_536
#: Characters of texts whose words are looked up and hashed at once; texts beyond the last are read word by word.
CHARACTERS_AT_ONCE, CODES_AT_ONCE, LONG = 300_000, 50_000, 5_000_000
#: Share of the score to reach that frequent words, looked up only for likely texts, may add.
LATE = 0.5
#: Texts that are scored whole without a look at sums.
FEW = 100
#: Parts of scores in whole steps (rounded up) for a first look, and the largest sum of them.
STEP, LARGEST = 1 / 400, 65_000
#: Units that stand in more than one of so many texts have a row of parts for all texts, up to so many units.
OFTEN, ROWS = 40, 600
#: Texts that stay likely and are no longer worth a closer look; groups of texts whose best give a first bound.
LIKELY, GROUPS = 16, 1_024
#: Queries that are made ready at once, and whose likely texts are scored at once.
QUERIES_AT_ONCE, SCORED_AT_ONCE = 4_096, 64
#: Scores of queries by texts that a worker holds at once.
CELLS = 2_000_000
_WORD = re.compile(r"[^\W_]+")


def query_units(query: Column) -> Column:
    """The units of a query: its white-space-separated tokens, each a word or, where there is
    punctuation inside, a phrase of words; lower case, distinct."""
    tokens = F.split(F.lower(F.regexp_replace(query, '"', "")), r"\s+")
    units = F.transform(tokens, lambda t: F.array_join(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), 0), " "))
    return F.array_distinct(F.filter(units, lambda u: u != ""))


def _counter(units: Iterable[str]) -> Callable[[list[str]], dict[str, int]]:
    """A function of a text's words: how often each of the units (words or phrases) stands there."""
    single: set[str] = set()
    phrases: set[str] = set()
    sizes: dict[str, set[int]] = {}  # of the phrases that begin with a word
    for u in units:
        words = u.split(" ")
        if len(words) == 1:
            single.add(u)
        else:
            phrases.add(u)
            sizes.setdefault(words[0], set()).add(len(words))

    def count(words: list[str]) -> dict[str, int]:
        held = Counter(words)
        found = {w: held[w] for w in held.keys() & single}
        if held.keys() & sizes.keys():
            for at, w in enumerate(words):
                for n in sizes.get(w, ()):
                    if at + n <= len(words) and (p := " ".join(words[at : at + n])) in phrases:
                        found[p] = found.get(p, 0) + 1
        return found

    return count


@cache
def _word_characters() -> np.ndarray:
    """Of every code point whether it is one of a word's."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the base of the words' hashes and of its inverse, modulo 2 to the 64."""
    base, one = 0x9E3779B97F4A7C15, np.ones(1, np.uint64)
    powers = lambda x: np.concatenate([one, np.cumprod(np.full(n - 1, x, np.uint64))])
    return powers(base), powers(pow(base, -1, 1 << 64))


class _Units:
    """Which of the units (words or phrases) stand in texts, and how often, for many texts at once:
    as _counter says, by steps of all their words. Words are found by a hash and then compared."""

    def __init__(self, units: list[str]):
        number: dict[str, int] = {}
        single, ends, steps = {}, {}, {}
        self.first: dict[int, int] = {}  # node of a phrase's first word
        for i, u in enumerate(units):
            if not all(w.isalnum() for w in u.split(" ")):
                continue  # no text has such a word
            words = [number.setdefault(w, len(number)) for w in u.split(" ")]
            if len(words) == 1:
                single[words[0]] = i
                continue
            node = self.first.setdefault(words[0], len(self.first) + len(steps))
            for w in words[1:]:
                node = steps.setdefault((node, w), len(self.first) + len(steps))
            ends[node] = i
        self.count_units, self.count_words = len(units), max(1, len(number))
        of = lambda held, n: np.array([held.get(k, -1) for k in range(n)], np.int64)
        self.unit, self.node = of(single, len(number)), of(self.first, len(number))
        self.end = of(ends, len(self.first) + len(steps))
        order = sorted(steps, key=lambda x: x[0] * self.count_words + x[1])
        self.step = np.array([n * self.count_words + w for n, w in order], np.int64)
        self.to = np.array([steps[x] for x in order], np.int64)
        self.codes, self.start, self.size = self._cut("\n".join(number))
        self.hash = self._hashes(self.codes, self.start, self.size)
        #: Words of one hash can't be told apart by it.
        self.clash = len(np.unique(self.hash)) < len(number)
        self.mask = np.uint64((1 << max(4, (4 * len(number)).bit_length())) - 1)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        left, spot = np.arange(len(self.hash)), (self.hash & self.mask).astype(np.int64)
        while len(left) and not self.clash:
            free = self.table[spot] < 0
            self.table[spot[free]] = left[free]
            on = self.table[spot] != left
            left, spot = left[on], (spot[on] + 1) & int(self.mask)

    @staticmethod
    def _cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of a text, and where its words begin and how long they are."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(codes) + 2, bool)
        np.take(_word_characters(), codes, out=inside[1:-1], mode="clip")
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        return codes, turns[::2], turns[1::2] - turns[::2]

    @staticmethod
    def _hashes(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = np.zeros(len(start), np.uint64)
        cuts = np.unique(np.searchsorted(start, np.arange(0, len(codes) + CODES_AT_ONCE, CODES_AT_ONCE))).tolist()
        for i, j in zip(cuts, cuts[1:]):
            low, high = int(start[i]), int(start[j - 1] + size[j - 1])
            powers, inverse = _powers(1 << max(16, (high - low).bit_length()))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[low:high] * powers[: high - low])])
            at = start[i:j] - low
            h[i:j] = (sums[at + size[i:j]] - sums[at]) * inverse[at]
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) ^ (h >> np.uint64(29))

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a text begin, and their numbers: -1 for those of no unit."""
        codes, start, size = self._cut(text)
        h = self._hashes(codes, start, size)
        out = np.full(len(h), -1, np.int64)
        left, spot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(left):
            held = self.table[spot]
            same = held >= 0
            same[same] = self.hash[held[same]] == h[left[same]]
            out[left[same]] = held[same]
            on = (held >= 0) & ~same
            left, spot = left[on], (spot[on] + 1) & int(self.mask)
        found = np.flatnonzero(out >= 0)
        found = found[size[found] == self.size[out[found]]]
        sizes = size[found]
        ends = np.cumsum(sizes)
        place = np.arange(sizes.sum()) + np.repeat(start[found] - (ends - sizes), sizes)
        wrong = np.flatnonzero(codes[place] != self.codes[place + np.repeat(self.start[out[found]] - start[found], sizes)])
        good = np.ones(len(found), bool)
        good[np.searchsorted(ends, wrong, "right")] = False
        kept = np.full(len(h), -1, np.int64)
        kept[found[good]] = out[found[good]]
        return start, kept

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many words each text has; of each text in turn: the number of units found, the units, how often each."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        start, word = self.words("\n".join(texts))
        words = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
        text = np.repeat(np.arange(len(texts)), words)
        known = np.flatnonzero(word >= 0)
        unit = self.unit[word[known]]
        keys = [(text[known] * self.count_units + unit)[unit >= 0]]
        node = self.node[word[known]]
        at, node = known[node >= 0], node[node >= 0]
        while len(at):
            at = at + 1
            on = at < len(word)
            on[on] = (word[at[on]] >= 0) & (text[at[on]] == text[at[on] - 1])
            at, node = at[on], node[on]
            step = node * self.count_words + word[at]
            spot = np.minimum(np.searchsorted(self.step, step), len(self.step) - 1)
            on = self.step[spot] == step
            at, node = at[on], self.to[spot[on]]
            unit = self.end[node]
            keys.append((text[at] * self.count_units + unit)[unit >= 0])
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        return words, np.bincount(key // self.count_units, minlength=len(texts)), key % self.count_units, times


def _read(texts: DataFrame, units: list[str]) -> DataFrame:
    """id, dl, u, tf: of every text its number of words, and which of the units (by their
    number) stand there how often. The one pass over the texts; what follows reads this."""
    sent = texts.sparkSession.sparkContext.broadcast(units)
    id_type = texts.schema["id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, slow = _Units(sent.value), cache(lambda: (_counter(sent.value), {u: i for i, u in enumerate(sent.value)}))

        def one_by_one(texts: list[str]) -> tuple[list[int], ...]:
            found, number = slow()
            held = [(len(words), found(words)) for words in map(_WORD.findall, texts)]
            return [n for n, _ in held], [len(f) for _, f in held], [number[u] for _, f in held for u in f], [n for _, f in held for n in f.values()]

        for b in batches:
            parts, some, size = [([],) * 4], [], 0
            for last, t in enumerate(b.column(1).to_pylist(), 1 - b.num_rows):
                some.append(t or "")
                size += len(some[-1]) + 1
                if size >= CHARACTERS_AT_ONCE or not last:
                    parts.append(one_by_one(some) if known.clash or size > LONG else known.count(some))
                    some, size = [], 0
            lengths, held, us, tfs = (np.concatenate(x).astype(np.int32) for x in zip(*parts))
            ends = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
            dl = pa.array(lengths, mask=b.column(1).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), dl, pa.ListArray.from_arrays(ends, pa.array(us)), pa.ListArray.from_arrays(ends, pa.array(tfs))], names=["id", "dl", "u", "tf"])

    return written(texts.mapInArrow(read, f"id {id_type.simpleString()}, dl int, u array<int>, tf array<int>"))


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, count: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query, ties to the smaller id, and each query's least score
    still of use (a little less, as scores are ranked in steps of 1e-9)."""
    order = np.lexsort((ids, -np.floor(score * 1e9), q))
    q, score, ids = q[order], score[order], ids[order]
    at = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, np.arange(count))[q] < k)
    q, score, ids = q[at], score[at], ids[at]
    sizes = np.bincount(q, minlength=count)
    bound = np.full(count, -np.inf)
    full = np.flatnonzero(sizes == k)
    bound[full] = score[np.cumsum(sizes)[full] - 1] - 2e-9
    return q, score, ids, bound


def _scored(texts: DataFrame, asked: list[tuple[object, list[str]]], k: int, every: bool, schema: StructType) -> DataFrame:
    """query_id, id, score: the k best texts of each task for each query of a block. The scores
    of a batch are one table of queries by texts, so what a frequent word adds is no row of a join."""
    units = sorted({u for _, of in asked for u in of})
    read = _read(texts, units)
    n_all, avgdl = read.agg(F.count(F.lit(1)), F.avg("dl")).first()
    holders = {r["u"]: r["n"] for r in read.where("id IS NOT NULL").select(F.explode("u").alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {u: max(math.log((n_all - n + 0.5) / (n + 0.5)), LEAST_IDF) for u, n in holders.items()}
    sent = texts.sparkSession.sparkContext.broadcast((asked, units, idf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, units, idf = sent.value
        number = {u: i for i, u in enumerate(units)}
        wanted = np.array([len(of) for _, of in asked])
        places: dict[int, Counter] = {}
        for i, (_, of) in enumerate(asked):
            for u in of:
                places.setdefault(number[u], Counter())[i] += 1
        by_unit = {u: (np.fromiter(c.keys(), np.int64), np.fromiter(c.values(), np.float64)) for u, c in places.items() if u in idf}
        step = max(1, CELLS // len(asked))
        held: tuple[np.ndarray, ...] = ()
        id_kind = None
        for whole in batches:
            id_kind = whole.schema.field(0).type
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                base = K1 * (1 - B + B * b.column(1).to_numpy(zero_copy_only=False).astype(np.float64) / avgdl)
                lists = b.column(2)
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                unit, tfs = lists.flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.float64)
                order = np.argsort(unit, kind="stable")
                row, unit, tfs = row[order], unit[order], tfs[order]
                table = np.zeros((len(asked), b.num_rows))
                met = np.zeros((len(asked), b.num_rows), np.int32) if every else None
                starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else []
                for s, e in zip(starts, [*starts[1:], len(unit)]):
                    at, tf, u = row[s:e], tfs[s:e], int(unit[s])
                    part = idf[u] * tf * (K1 + 1) / (tf + base[at])
                    queries, times = by_unit[u]
                    table[np.ix_(queries, at)] += times[:, None] * part
                    if every:
                        met[np.ix_(queries, at)] += times.astype(np.int32)[:, None]
                q, at = np.nonzero(met == wanted[:, None]) if every else np.nonzero(table)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                found = (q, table[q, at], (ids.astype(str) if ids.dtype == object else ids)[at])
                if held:  # of what is worse than the k best so far nothing need be kept
                    use = np.flatnonzero(found[1] >= held[3][q])
                    found = tuple(np.concatenate(x) for x in zip(held[:3], (f[use] for f in found)))
                held = _best(*found, k, len(asked))
        if held:
            q, scores, ids = held[:3]
            yield pa.RecordBatch.from_arrays(
                [pa.array([asked[i][0] for i in q], query_type), pa.array(ids.tolist(), id_kind), pa.array(scores)], names=["query_id", "id", "score"]
            )

    query_type = to_arrow_type(schema["query_id"].dataType)
    return read.where("id IS NOT NULL AND size(u) > 0").mapInArrow(score, schema)


class _Index:
    """Texts by unit and units by text, with what each unit adds to the score of each text."""

    def __init__(self, batches: list[pa.RecordBatch], idf: np.ndarray, avgdl: float):
        t = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        ids = t.column(0).to_numpy(zero_copy_only=False)
        self.ids, self.n = (ids.astype(str) if ids.dtype == object else ids), t.num_rows
        base = K1 * (1 - B + B * t.column(1).to_numpy(zero_copy_only=False).astype(np.float64) / avgdl)
        counts = np.diff(t.column(2).offsets.to_numpy())
        row = np.repeat(np.arange(self.n), counts)
        unit, tf = t.column(2).flatten().to_numpy(), t.column(3).flatten().to_numpy().astype(np.float64)
        order = np.argsort(row * len(idf) + unit)
        self.unit, self.first = unit[order], np.r_[0, np.cumsum(counts)]
        self.adds = (idf[unit] * tf * (K1 + 1) / (tf + base[row]))[order]
        order = np.argsort(self.unit.astype(np.int64) * self.n + row)
        by = self.unit[order]
        self.rows, self.parts = row[order], self.adds[order]
        self.begin = np.searchsorted(by, np.arange(len(idf) + 1))
        self.most = np.zeros(len(idf))
        if len(by):
            starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            self.most[by[starts]] = np.maximum.reduceat(self.parts, starts)
        self.times = np.zeros(len(idf))
        # In steps, rounded up: sums of these are never too low.
        self.steps = np.minimum(np.ceil(self.parts / STEP), LARGEST).astype(np.uint16)
        held = np.diff(self.begin)
        often = np.argsort(-held, kind="stable")[:ROWS]
        often = often[held[often] * OFTEN > self.n]
        self.width = -(-self.n // GROUPS) * GROUPS
        self.whole = {u: np.zeros(self.width, np.uint16) for u in often.tolist()}
        for u, row in self.whole.items():
            row[self.rows[self.begin[u] : self.begin[u + 1]]] = self.steps[self.begin[u] : self.begin[u + 1]]
        self.sum, self.mask = np.zeros(self.width, np.uint16), np.zeros(self.width, bool)
        self.marks = np.zeros((SCORED_AT_ONCE, len(idf)), np.uint8)

    def score(self, at: np.ndarray, units: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of some texts: each text's units added in the order of their numbers."""
        self.times[units] = times
        sizes = self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        spot = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - (ends - sizes), sizes)
        out = np.bincount(np.repeat(np.arange(len(at)), sizes), self.adds[spot] * self.times[self.unit[spot]], len(at))
        self.times[units] = 0
        return out

    def holders(self, units: np.ndarray) -> np.ndarray:
        return np.concatenate([self.rows[s:e] for s, e in zip(self.begin[units].tolist(), self.begin[units + 1].tolist())])

    def reach(self, begin: np.ndarray, units: np.ndarray, times: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, texts and their scores: of each query all texts that are among its k best and
        reach its bound, perhaps others. begin: where the units of each query begin.

        The words that most texts hold add little. As long as they cannot add more than a share
        of what must be reached, texts are found by the other words, and only those that could
        reach it with the most that these words add are scored whole."""
        for low in range(0, len(bounds), QUERIES_AT_ONCE):
            high = min(low + QUERIES_AT_ONCE, len(bounds))
            span = slice(begin[low], begin[high])
            q, u, t = np.repeat(np.arange(high - low), np.diff(begin[low : high + 1])), units[span], times[span]
            held = self.begin[u + 1] - self.begin[u]
            order = np.lexsort((held, q))  # rarer units first
            order = order[held[order] > 0]
            q, u, t, held = q[order], u[order], t[order], held[order]
            most = self.most[u] * t
            sums, first = np.cumsum(most), np.searchsorted(q, np.arange(high - low + 1))
            late = np.r_[0.0, sums][first[1:]][q] - sums + most  # the most that a unit and all more frequent ones of the query add
            bound = bounds[low:high][q]
            need, early = (late >= bound - 1e-6) | (bound <= 0), (late > LATE * bound) | (bound <= 0)
            count = lambda x: np.bincount(q, x, high - low).astype(np.int64)
            needed, now, holders = count(need), count(early), count(held * need)
            plain = (count(t != 1) == 0) & (np.bincount(q, most / STEP + 1, high - low) <= LARGEST)
            found: list[tuple[int, np.ndarray]] = []
            for i in np.flatnonzero(needed).tolist():
                s, e, least = first[i], first[i + 1], bounds[low + i]
                if holders[i] <= FEW:  # a text without these cannot reach it
                    at = np.unique(self.holders(u[s : s + needed[i]]))
                elif plain[i]:
                    at = self.likely(u[s:e].tolist(), late[s:e], int(now[i]), k, least)
                else:
                    rest = late[s + now[i]] if now[i] < e - s else 0.0
                    at, _ = self.sums(u[s : s + now[i]], u[s:e], t[s:e], least - rest - 1e-6)
                if not len(at):
                    continue
                if plain[i]:
                    found.append((i, at))
                    if len(found) == SCORED_AT_ONCE:
                        yield self.scored(found, u, first, low)
                        found = []
                else:
                    yield np.full(len(at), low + i), at, self.score(at, u[s:e], t[s:e])
            if found:
                yield self.scored(found, u, first, low)

    def scored(self, found: list[tuple[int, np.ndarray]], units: np.ndarray, first: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As score does, for texts of some queries in which no unit stands twice."""
        for j, (i, _) in enumerate(found):
            self.marks[j, units[first[i] : first[i + 1]]] = 1
        at = np.concatenate([x for _, x in found])
        j = np.repeat(np.arange(len(found)), [len(x) for _, x in found])
        out = np.zeros(len(at))
        for s in range(0, len(at), 50_000):
            some = at[s : s + 50_000]
            sizes = self.first[some + 1] - self.first[some]
            ends = np.cumsum(sizes)
            pair = np.repeat(np.arange(len(some)), sizes)
            spot = np.arange(ends[-1]) + (self.first[some] - (ends - sizes))[pair]
            use = np.flatnonzero(self.marks[j[s : s + 50_000][pair], self.unit[spot]])
            out[s : s + 50_000] = np.bincount(pair[use], self.adds[spot[use]], len(some))
        for k, (i, _) in enumerate(found):
            self.marks[k, units[first[i] : first[i + 1]]] = 0
        return np.array([i for i, _ in found])[j] + low, at, out

    def likely(self, units: list[int], late: np.ndarray, n: int, k: int, bound: float) -> np.ndarray:
        """Texts that may be among the k best and reach the bound, by sums of steps: first of the n
        rarest units for all texts, then of one more unit at a time for those that are left."""
        total = self.sum
        total.fill(0)
        for u in units[:n]:
            if (row := self.whole.get(u)) is not None:
                np.add(total, row, out=total)
            else:
                span = slice(self.begin[u], self.begin[u + 1])
                total[self.rows[span]] += self.steps[span]
        if bound <= 0:  # the k-th of the best of groups is no better than the k-th of all
            best = total.reshape(-1, GROUPS).max(axis=0)
            if k <= GROUPS:
                bound = (int(np.partition(best, GROUPS - k)[GROUPS - k]) - len(units)) * STEP
        least = lambda n: np.uint16(max(1, math.ceil((bound - (late[n] if n < len(units) else 0.0) - 1e-6) / STEP)) if bound > 0 else 1)
        at = np.flatnonzero(np.greater_equal(total, least(n), out=self.mask))
        sums = total[at]
        while n < len(units) and len(at) > LIKELY:
            u = units[n]
            if (row := self.whole.get(u)) is not None:
                sums += row[at]
            else:
                rows = self.rows[self.begin[u] : self.begin[u + 1]]
                spot = np.minimum(np.searchsorted(rows, at), len(rows) - 1)
                sums += np.where(rows[spot] == at, self.steps[self.begin[u] + spot], np.uint16(0))
            n += 1
            keep = sums >= least(n)
            at, sums = at[keep], sums[keep]
        return at

    def sums(self, now: np.ndarray, units: np.ndarray, times: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The texts to whose scores the units ``now`` add something, and ``least`` at least; and what."""
        spans = list(zip(self.begin[now].tolist(), self.begin[now + 1].tolist()))
        rows, parts = (np.concatenate([x[s:e] for s, e in spans]) for x in (self.rows, self.parts))
        if (times != 1).any():
            self.times[units] = times
            parts = parts * np.repeat(self.times[now], [e - s for s, e in spans])
            self.times[units] = 0
        sums = np.bincount(rows, parts, self.n)
        at = np.flatnonzero(sums >= least if least > 0 else sums > 0)
        return at, sums[at]


def _ranked(texts: DataFrame, asked: tuple[list, np.ndarray, np.ndarray, np.ndarray], units: list[str], k: int, own: bool, schema: StructType) -> DataFrame:
    """query_id, id, score: the k best texts of each task for each query of a block, where any
    unit counts. asked: ids of the queries, where the units of each begin, their numbers and how
    often each is asked. own: only texts that are as good as the one with the query's id."""
    read = _read(texts, units)
    n_all, avgdl = read.agg(F.count(F.lit(1)), F.avg("dl")).first()
    idf = np.zeros(len(units))
    for r in read.where("id IS NOT NULL").select(F.explode("u").alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        idf[r["u"]] = max(math.log((n_all - r["n"] + 0.5) / (r["n"] + 0.5)), LEAST_IDF)
    sent = texts.sparkSession.sparkContext.broadcast((asked, idf))
    held = read.where("id IS NOT NULL AND size(u) > 0")
    query_type = to_arrow_type(schema["query_id"].dataType)

    def own_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, begin, numbers, times), idf = sent.value
        place = {q: i for i, q in enumerate(names)}
        for b in batches:
            at = np.array([i for i, x in enumerate(b.column(0).to_pylist()) if x in place], np.int64)
            if len(at):
                index = _Index([b.take(pa.array(at))], idf, avgdl)
                which = [place[x] for x in index.ids.tolist()]
                scores = [index.score(np.array([i]), numbers[begin[q] : begin[q + 1]], times[begin[q] : begin[q + 1]])[0] for i, q in enumerate(which)]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(scores, pa.float64())], names=["q", "score"])

    bounds = np.full(len(asked[0]), np.inf if own else -np.inf)
    if own:
        for r in cut(held.mapInArrow(own_scores, "q int, score double").where("score > 0")).toLocalIterator():  # all tasks at once
            bounds[r["q"]] = min(bounds[r["q"]], r["score"] - 2e-9)
    start = texts.sparkSession.sparkContext.broadcast(bounds)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, begin, numbers, times), idf = sent.value
        bounds, held = start.value.copy(), ()
        id_kind, block, size = None, [], 0

        def search() -> None:
            nonlocal held
            index = _Index(block, idf, avgdl)
            found: list[tuple[np.ndarray, ...]] = [held] if held else []
            for q, at, score in index.reach(begin, numbers, times, bounds, k):
                keep = np.flatnonzero((score >= bounds[q]) & (score > 0))
                found.append((q[keep], score[keep], index.ids[at[keep]]))
            if found:
                *held, least = _best(*(np.concatenate(x) for x in zip(*found)), k, len(names))
                np.maximum(bounds, least, out=bounds)

        for b in batches:
            if b.num_rows:
                id_kind = b.schema.field(0).type
                block.append(b)
                size += b.num_rows
            if size >= TEXTS_AT_ONCE:
                search()
                block, size = [], 0
        if block:
            search()
        for s in range(0, len(held[0]) if held else 0, 100_000):
            q, score, ids = (x[s : s + 100_000] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()], query_type), pa.array(ids.tolist(), id_kind), pa.array(score)], names=["query_id", "id", "score"])

    return held.repartition(math.ceil((n_all + 1) / TEXTS_AT_ONCE) + 5).mapInArrow(best, schema)


@for_workers
def bm25(
    queries: DataFrame, texts: DataFrame, k: int, *, query_id: str, query: str, text_id: str, text: Column, mode: str = "and", own: bool = False
) -> DataFrame:
    """query_id, id, score, rank: the k best texts of each query, rank from 1.

    In mode ``and`` all units of the query must occur, in mode ``or`` any. The score is the sum
    over units of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) with
    idf = max(ln((N - n + 0.5) / (n + 0.5)), 1e-6); lengths are in words, statistics are over
    all texts. Ties go to the smaller id. Queries without a word find nothing. With ``own``
    (mode ``or``) a query is given only what is ranked up to the text that has the query's id,
    and nothing where that text has none of its units.

    Queries are sent to the workers in blocks of bounded size; texts are read once per block,
    for the numbers of the block's words, from which statistics and scores are made. In mode
    ``or`` texts that cannot be among the k best are left out before they are scored whole.
    """
    units = queries.select(F.col(query_id).alias("query_id"), F.explode(query_units(F.col(query))).alias("unit"))
    rows = texts.select(F.col(text_id).alias("id"), F.lower(text).alias("t"))
    schema = StructType([StructField("query_id", units.schema["query_id"].dataType), StructField("id", rows.schema["id"].dataType), StructField("score", DoubleType())])
    found = rows.sparkSession.createDataFrame([], schema)
    number: dict[str, int] = {}
    block: list[tuple[object, np.ndarray, np.ndarray]] = []
    size = 0

    def answered() -> DataFrame:
        if mode == "and":
            named = list(number)
            asked = [(q, [named[u] for u, n in zip(us.tolist(), times.tolist()) for _ in range(n)]) for q, us, times in block]
            return _scored(rows, asked, k, True, schema)
        begin = np.cumsum([0, *(len(us) for _, us, _ in block)])
        flat = [np.concatenate(x) for x in list(zip(*block))[1:]]
        return _ranked(rows, ([q for q, _, _ in block], begin, *flat), list(number), k, own, schema)

    for r in units.groupBy("query_id").agg(F.collect_list("unit").alias("units")).toLocalIterator():
        counted = Counter(number.setdefault(u, len(number)) for u in r["units"])
        block.append((r["query_id"], np.fromiter(counted.keys(), np.int32), np.fromiter(counted.values(), np.int32)))
        size += len(r["units"])
        if size >= (UNITS_PER_PASS_AND if mode == "and" else UNITS_PER_PASS):
            found = found.unionByName(answered())
            number, block, size = {}, [], 0
    if block:
        found = found.unionByName(answered())
    order = Window.partitionBy("query_id").orderBy(F.floor(F.col("score") * 1e9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
