"""Best-fit packing of token sequences, then a swap-based local search.

Only the histogram of piece lengths (at most `capacity` rows, whatever the corpus) reaches the driver. There, best fit in
descending order runs on groups of equal bins rather than on bins; the local search, on such groups too, then moves
pieces between underfull bins, exchanges one for one or two for one, always raising the sum of squared fills, until the
bins are as few as can be or no step helps. The plan that comes out says which ranks of a length go to which bins, so the pieces need only a rank
within their length; ranks are taken in salted groups of bounded size.

Defined cases: a null or empty text is one piece of one token (the end token); repeated rows are packed one by one;
ties of length are broken by id and piece; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import bpe, default_vocabulary
from .common import keyed, lean, stored

CAPACITY = 2048
#: Pieces that one group of ranks may hold on average.
RANKED = 100_000
SALTS = 64


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY,
           vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut only where longer than capacity."""
    path = vocabulary or default_vocabulary()
    d = keyed(docs, id_col, text_col)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        coder = bpe(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k in range(b.num_rows):
                ids = coder.encode(b.column(1)[k].as_py()) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch(
                [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit in descending order, on groups of equal bins: (number of bins, [(length, how often in each)])."""
    room: dict[int, list[list]] = defaultdict(list)  # free space -> groups [bins, items]
    spaces: list[int] = []

    def put(space: int, bins: int, items: tuple) -> None:
        if not room[space]:
            insort(spaces, space)
        room[space].append([bins, items])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = bisect_left(spaces, length)
        while left and at < len(spaces):
            space = spaces[at]
            each = space // length
            groups = room[space]
            while groups and left:
                bins, items = groups.pop()
                full = min(bins, left // each)
                if full:
                    put(space - each * length, full, (*items, (length, each)))
                    left -= full * each
                rest = bins - full
                if rest and left:  # fewer than `each` are left: one more bin takes them
                    put(space - left * length, 1, (*items, (length, left)))
                    left, rest = 0, rest - 1
                if rest:
                    groups.append([rest, items])
            if not groups:
                spaces.pop(bisect_left(spaces, space))
            at = bisect_left(spaces, max(length, space if not groups else space))
        if left:
            each = capacity // length
            if full := left // each:
                put(capacity - each * length, full, ((length, each),))
            if rest := left % each:
                put(capacity - rest * length, 1, ((length, rest),))
    return [(bins, list(items)) for groups in room.values() for bins, items in groups]


class _Kind:
    """Underfull bins of equal items."""

    def __init__(self, items: tuple, fill: int, capacity: int):
        self.bins, self.items, self.fill, self.free = 0, items, fill, capacity - fill
        self.sums: dict[int, tuple] = {}  # of one or two pieces, and which
        self.wanted = 0  # as bits: the sums that raise such a bin as a target
        for i, (x, k) in enumerate(items):
            for z, n in ((x, k - 1), *items[i + 1 :]):
                if n:
                    self.sums.setdefault(x + z, (x, z))
        self.sums |= {x: (x,) for x, _ in items}
        for y in (0, *(x for x, _ in items)):
            self.wanted |= ((1 << self.free) - 1) << y + 1


def local_search(groups: list, capacity: int = CAPACITY) -> list:
    """On all underfull bins, equal ones together: always to a bin from one at most as full, moves one or two pieces or
    exchanges them for one smaller than their sum, in as many pairs of such bins as there are; the fullest bins first,
    each by the step that fills it most, from the emptiest bins. Each step raises the sum of squared fills. It ends when
    the bins are as few as their sum allows, or when no pair of bins has a step left."""
    fill = lambda items: sum(x * k for x, k in items)
    least = -(-sum(bins * fill(items) for bins, items in groups) // capacity)
    now = sum(n for n, _ in groups)
    kept: list[tuple[int, list]] = []
    kinds: dict[tuple, _Kind] = {}
    holders: dict[int, list] = defaultdict(list)  # sum -> heap of (fill, items) of kinds that have it, or had
    fresh: list[tuple] = []  # heap of (-fill, items) of kinds whose pairs with others may have a step

    def put(n: int, items: tuple) -> None:
        kind = kinds.get(items)
        if kind is None:
            if (f := fill(items)) >= capacity:
                kept.append((n, list(items)))
                return
            kind = kinds[items] = _Kind(items, f, capacity)
            for v in kind.sums:
                heappush(holders[v], (f, items))
        if kind.bins < 2:  # a second bin makes a new pair, a third doesn't
            heappush(fresh, (-kind.fill, items))
        kind.bins += n

    def emptiest(v: int, target: _Kind) -> _Kind | None:
        heap, own, out = holders.get(v), False, None
        while heap:
            f, items = heap[0]
            if f > target.fill:
                break
            if items in kinds and (items != target.items or target.bins > 1):
                out = kinds[items]
                break
            own |= items == target.items and items in kinds
            heappop(heap)
        if own:
            heappush(heap, (target.fill, target.items))
        return out

    def best_step(target: _Kind) -> tuple | None:
        own = [0, *(x for x, _ in target.items)]
        for gain in range(target.free, 0, -1):
            found = [(k.fill, y, k) for y in own if y + gain in holders and (k := emptiest(y + gain, target))]
            if found:
                _, y, source = min(found, key=lambda c: c[:2])
                return source, source.sums[y + gain], (y,) if y else ()
        return None

    for n, items in groups:
        put(n, tuple(sorted(items, reverse=True)))
    while fresh and now > least:
        target = kinds.get(heappop(fresh)[1])
        if target is None:
            continue
        step = best_step(target)
        if step is None:  # as a source, it may serve fuller bins that were looked at before
            sums = sum(1 << v for v in target.sums)
            for k in kinds.values():
                if k.wanted & sums and k.fill >= target.fill and k is not target:
                    heappush(fresh, (-k.fill, k.items))
            continue
        source, give, back = step
        times = target.bins // 2 if source is target else min(source.bins, target.bins)
        for kind in (source, target):
            kind.bins -= times
        for kind in {source, target}:
            if not kind.bins:
                del kinds[kind.items]
        if target.bins:
            heappush(fresh, (-target.fill, target.items))
        for items, lost, got in ((source.items, give, back), (target.items, back, give)):
            after = Counter(dict(items))
            after.subtract(lost)
            after.update(got)
            if left := tuple(sorted(((x, k) for x, k in after.items() if k), reverse=True)):
                put(times, left)
            else:
                now -= times
    return kept + [(k.bins, list(items)) for items, k in kinds.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, each, first sequence, offset): of the pieces of that length, `ranks` from the first
    rank on go to consecutive sequences, `each` to a sequence, from that offset on."""
    rows, used, sequence = [], Counter(), 0
    for bins, items in local_search(best_fit(counts, capacity), capacity):
        offset = 0
        for length, each in items:
            rows.append((length, used[length], bins * each, each, sequence, offset))
            used[length] += bins * each
            offset += each * length
        sequence += bins
    return rows


def packed(parts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length and more; read more than once), each with its sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    salts = max(SALTS, sum(counts.values()) // RANKED)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = parts.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    sizes = sizes.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = parts.withColumn("own", own).join(sizes, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")
    # a row for each length and group of bins: bounded by the capacity, not by the corpus
    rows = spark.createDataFrame(
        plan(counts, capacity), "length bigint, first bigint, ranks bigint, each bigint, sequence bigint, at bigint"
    )
    joined = ranked.join(F.broadcast(rows.withColumnRenamed("length", "of")),
                         F.expr("length = of AND rank >= first AND rank < first + ranks"))
    return joined.withColumns({
        "sequence_id": F.expr("sequence + (rank - first) div each"),
        "offset": F.expr("at + (rank - first) % each * length"),
    }).drop("of", "first", "ranks", "each", "sequence", "at", "rank")


def op4(docs: DataFrame) -> DataFrame:
    return packed(stored(pieces(docs), "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def stage(docs: DataFrame) -> DataFrame:
    return op4(docs)
