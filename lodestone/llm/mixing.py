"""Mixing sources to target weights by min-cost flow.

Documents with the same text are one document that belongs to several sources. Documents are
aggregated by membership pattern; from each pattern tokens flow to the quotas of its sources,
the first use of a token for nothing and each repetition at a higher (convex) cost. The flow,
a matter of patterns and sources alone, is solved on the driver; the documents themselves are
then taken by their seeded place within their pattern, in Spark.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.session import cut, for_workers

#: The tokenizer's vocabulary file where none is given.
TOKENIZER = os.environ.get("LODESTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Membership patterns are gathered on the driver (about 1 KB each); more than this many are
#: refused with an error.
MOST_PATTERNS = 200_000
#: Documents of a pattern whose places are found within one task.
PLACED_AT_ONCE = 20_000


@for_workers
def token_counts(records: DataFrame, *columns: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """The given columns and ``tokens``, the number of tokens of the text under a public
    tokenizer's vocabulary file (null and empty texts have 0)."""
    rows = records.select(*columns, text.cast("string").alias("_text"))
    names = rows.columns[:-1]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            n: list[int] = []
            for i in range(0, len(texts), 256):
                part = [x or "" for x in texts[i : i + 256]]
                n += [len(e) for e in t.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(n, pa.int64())], names=[*names, "tokens"])

    return rows.mapInArrow(count, schema)


class Flow:
    """Min-cost flow from patterns to sources, kept as arrays of patterns by sources.

    The only costs are those of the layers: the r-th use of a pattern's tokens costs r - 1.
    Every augmenting path begins with one layer and undoes none, so its cost is that of its
    layer, and the cheapest flow is a greatest flow made layer by layer. Paths are sought
    between sources alone (tokens of a pattern may pass from one of its sources to another),
    so a step costs array operations over the patterns and there are few steps.
    """

    def __init__(self, member: np.ndarray, tokens: np.ndarray, quotas: np.ndarray, repeats: np.ndarray):
        self.tokens, self.need = tokens, quotas.copy()
        self.room = np.where(member, tokens[:, None] * repeats[None, :], 0)
        self.flow = np.zeros_like(self.room)
        self.free = np.zeros_like(tokens)
        uses = np.where(member, repeats[None, :], 0).max(axis=1, initial=0)
        for layer in range(int(uses.max(initial=0))):
            self.free += np.where(uses > layer, tokens, 0)
            while self._push():
                pass

    def _push(self) -> bool:
        """One augmentation, along a path with the fewest sources; False where there is none."""
        if not (self.need > 0).any():
            return False
        count = len(self.need)
        came: dict[int, int | None] = {}
        queue = []
        for s in range(count):
            if np.minimum(self.free, self.room[:, s]).any():
                came[s] = None
                queue.append(s)
        at = 0
        while at < len(queue):
            s = queue[at]
            at += 1
            if self.need[s] > 0:
                break
            for t in range(count):
                if t not in came and np.minimum(self.flow[:, s], self.room[:, t]).any():
                    came[t] = s
                    queue.append(t)
        else:
            return False
        path = [s]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        moves = [np.minimum(self.free, self.room[:, path[0]])]
        moves += [np.minimum(self.flow[:, x], self.room[:, y]) for x, y in zip(path, path[1:])]
        amount = min(int(self.need[s]), *(int(m.sum()) for m in moves))
        for k, m in enumerate(moves):
            part = np.minimum(m, np.maximum(0, amount - (np.cumsum(m) - m)))
            if k:
                self.flow[:, path[k - 1]] -= part
                self.room[:, path[k - 1]] += part
            else:
                self.free -= part
            self.flow[:, path[k]] += part
            self.room[:, path[k]] -= part
        self.need[s] -= amount
        return True


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple, dict[str, int]]:
    """Tokens that each pattern gives to each of its sources, with as little repetition as can be."""
    names = sorted(quotas)
    place = {s: i for i, s in enumerate(names)}
    keys = sorted(patterns)
    member = np.zeros((len(keys), len(names)), bool)
    for i, key in enumerate(keys):
        for s in key:
            if s in place:
                member[i, place[s]] = True
    number = lambda values: np.array(values, np.int64)
    flow = Flow(member, number([patterns[k] for k in keys]), number([quotas[s] for s in names]), number([repeats[s] for s in names])).flow
    out: dict[tuple, dict[str, int]] = defaultdict(dict)
    for i, j in zip(*np.nonzero(flow)):
        out[keys[i]][names[j]] = int(flow[i, j])
    return out


def _quotas(total: int, weights: dict[str, float]) -> dict[str, int]:
    whole = sum(weights.values())
    return {s: int(total * w / whole) for s, w in weights.items()}


def plan(patterns: dict[tuple, int], weights: dict[str, float], repeats: dict[str, int], total: int | None):
    """(quotas, routes). Without a given total the collection is as large as one pass over the
    sources, or, where repetition caps forbid that, as large as keeps the target shares."""
    there = {s for key in patterns for s in key}
    held = {s: w for s, w in weights.items() if s in there and w > 0}
    if not held:
        return {}, {}

    def fits(size: int) -> dict | None:
        q = _quotas(size, held)
        r = route(patterns, q, repeats)
        return r if sum(sum(x.values()) for x in r.values()) >= sum(q.values()) else None

    if total is not None:
        q = _quotas(total, held)
        return q, route(patterns, q, repeats)
    high = sum(patterns.values())
    best = fits(high)
    low = 0
    if best is None:
        for _ in range(24):
            mid = (low + high) // 2
            if (r := fits(mid)) is not None:
                low, best = mid, r
            else:
                high = mid
        if best is None:
            best = route(patterns, _quotas(low, held), repeats)
    else:
        low = high
    return _quotas(low, held), best


@for_workers
def mix_sources(
    documents: DataFrame,
    doc_id: Column,
    text: Column,
    source: Column,
    targets: DataFrame,
    *,
    total_tokens: int | None = None,
    tokenizer: str = TOKENIZER,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: id, source, repeats, tokens - the documents taken for each source, how often,
    and the tokens of one use. shares: source, weight, target_share, quota_tokens, tokens,
    actual_share, documents, within - a row per listed source. A source without documents can
    have no share, so target shares, quotas and actual shares are all of the sources that have
    documents and a weight; the others show 0. ``within`` bounds how far the tokens may lie
    from the quota: half the largest document of each pattern that serves the source.

    ``targets`` has source, weight, max_repeats. Weights that are null, NaN or not positive
    and caps below one count as zero and take nothing; a source listed twice counts with the
    sum of its weights and its larger cap. Documents with a null or unlisted source or
    without tokens take no part. Equal texts are one document, known by the least id, that
    any of its sources may use; its uses for a source stay within that source's cap. Within
    half a document per source and pattern the tokens are those of the flow. The same seed
    gives the same selection. Empty tables give empty results. Other columns play no part.
    """
    listed = [
        (r["source"], float(r["w"]), int(r["m"]))
        for r in targets.groupBy("source")
        .agg(
            F.sum(F.when(F.col("weight").isNotNull() & ~F.isnan(F.col("weight").cast("double")) & (F.col("weight") > 0), F.col("weight")).otherwise(0.0)).alias("w"),
            F.coalesce(F.max("max_repeats"), F.lit(0)).alias("m"),
        )
        .where("source IS NOT NULL")
        .collect()
    ]
    weights = {s: (w if m > 0 else 0.0) for s, w, m in listed}
    repeats = {s: m for s, _, m in listed}
    active = sorted(s for s, w in weights.items() if w > 0)

    counted = token_counts(
        documents.where(source.isin(active) if active else F.lit(False)),
        doc_id.alias("id"), source.alias("source"), F.md5(text.cast("string").cast("binary")).alias("h"),
        text=text, tokenizer=tokenizer,
    )
    # One row per text; copies shrink to their sources and least id before the shuffle.
    items = (
        counted.where("tokens > 0 AND id IS NOT NULL")
        .groupBy("h")
        .agg(F.min("id").alias("id"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern"))
    )
    items = cut(items.withColumn("place", F.xxhash64(F.lit(seed), "h")))
    sums = items.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most"))
    rows = sums.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} combinations of sources")
    patterns = {tuple(r["pattern"]): r["tokens"] for r in rows}
    quotas, routes = plan(patterns, weights, repeats, total_tokens)

    # Segments of each pattern's uses: source j takes the uses between low and high, in
    # multiples of the pattern's tokens.
    segments = []
    for key, by in routes.items():
        at = 0.0
        for s in sorted(by):
            size = by[s] / patterns[key]
            segments.append((list(key), s, at, at + size))
            at += size
    spark = documents.sparkSession
    seg = spark.createDataFrame(segments, "pattern array<string>, source string, low double, high double")
    size = spark.createDataFrame(
        [(list(r["pattern"]), r["tokens"], max(1, r["n"] // PLACED_AT_ONCE)) for r in rows],
        "pattern array<string>, pattern_tokens long, bins long",
    )
    # The place of a document within its pattern: the share of tokens before it in seeded
    # order, found per bin of places, so that no pattern is sorted in one task.
    u = F.shiftrightunsigned(F.col("place"), 11) / F.lit(float(2**53))
    binned = items.join(F.broadcast(size), "pattern").withColumn("bin", F.floor(u * F.col("bins")))
    before = binned.groupBy("pattern", "bin").agg(F.sum("tokens").alias("bin_tokens"))
    over = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("before", F.coalesce(F.sum("bin_tokens").over(over), F.lit(0))).drop("bin_tokens")
    inside = Window.partitionBy("pattern", "bin").orderBy("place", "h").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.join(before, ["pattern", "bin"]).withColumn(
        "x",
        (F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens") / 2) / F.col("pattern_tokens"),
    )
    # Uses of a document at x, x + 1, ...; those between low and high are the source's.
    uses = F.greatest(F.ceil(F.col("high") - F.col("x")), F.lit(0)) - F.greatest(F.ceil(F.col("low") - F.col("x")), F.lit(0))
    selection = cut(
        placed.join(F.broadcast(seg), "pattern")
        .withColumn("repeats", uses.cast("long"))
        .where("repeats > 0")
        .select("id", "source", "repeats", "tokens")
    )
    got = selection.groupBy("source").agg(
        F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents")
    )
    whole = sum(weights[s] for s in quotas) or 1.0
    most = {tuple(r["pattern"]): r["most"] for r in rows}
    within = {s: sum(most[k] for k, by in routes.items() if s in by) / 2 for s in quotas}
    short = {s: quotas[s] - sum(by.get(s, 0) for by in routes.values()) for s in quotas}
    listing = spark.createDataFrame(
        [(s, w, weights[s] / whole if s in quotas else 0.0, quotas.get(s, 0), float(within.get(s, 0) + short.get(s, 0))) for s, w, _ in sorted(listed)],
        "source string, weight double, target_share double, quota_tokens long, within double",
    )
    every = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # a row per listed source
    shares = listing.join(F.broadcast(got), "source", "left").select(
        "source", "weight", "target_share", "quota_tokens",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.when(every > 0, F.coalesce("tokens", F.lit(0)) / every).otherwise(0.0).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), "within",
    )
    return selection, shares
