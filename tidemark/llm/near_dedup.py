"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document its set of word shingles (hashed to 64 bits), a MinHash signature and
   band keys. Documents with equal sets are one class from here on, stood for by the least id.
2. Classes that share a band key are candidates. A bucket never becomes all pairs: first, every member is compared with
   the bucket's least member; the confirmed links are closed to components; then, of buckets that
   hold several components, the members are compared across components, by an exact prefix filter on their sets. So no
   link that could join two components is lost.
3. Candidates are compared by batches of signature bytes. A pair is dropped as soon as the posterior probability that
   its similarity reaches the threshold, given the matches so far, falls below `miss`. Survivors are confirmed exactly
   on their full sets.

With 40 bands of 5 rows, a pair at the threshold of 0.8 shares no band with probability 1.3e-7.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle has its whole sequence as its set; a null id is counted but never linked; rows with equal ids
are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, counted, discard, keyed, lean, met, stored, told_apart
from .components import components
from .hashing import mix, runs, text_batches, words

BANDS, ROWS = 40, 5
BATCH = 40
#: Bits of a sketch.
SKETCH = 192
MISS = 1e-6
#: Ids of documents in candidate pairs that are broadcast (8 MB); more of them are joined by a shuffle of the texts.
IDS = 1_000_000
_U = np.uint64
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=_U)
_ROW = _rng.integers(0, 1 << 63, ROWS, dtype=_U) | _U(1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct shingles."""
    h, _, _, first = words(texts, lower=True)
    all_runs = runs(h, size)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(all_runs[a : b - size + 1]))
        elif b > a:
            n = int(b - a)
            out.append(mix(runs(h[a:b], n) + _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles ^ (shingles >> _U(32))).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        t = x[i : i + 256, None] * _A
        t += _B
        np.minimum(least, t.min(axis=0), out=least)
    return least


def signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, n (set size), f1, f2 (a fingerprint of the set; null if it is empty), sig (a byte for each hash), bands."""
    d = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            for at, part in text_batches(b.column(1)):
                n, f1, f2, sig, keys = [], [], [], [], []
                for s in shingle_sets(part, size):
                    n.append(len(s))
                    if not len(s):
                        f1.append(None), f2.append(None), sig.append(None), keys.append(None)
                        continue
                    f1.append(int(s.sum(dtype=_U).astype(np.int64)))
                    f2.append(int(mix(s + _U(1)).sum(dtype=_U).astype(np.int64)))
                    m = signature(s)
                    wide = mix(m.astype(_U))
                    sig.append(wide.astype(np.uint8).tobytes())
                    keys.append(mix((wide.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=_U) + _BAND).astype(np.int64))
                yield pa.record_batch(
                    [b.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(f1, pa.int64()),
                     pa.array(f2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n", "f1", "f2", "sig", "bands"],
                )

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(run), f"doc_id {kind}, n bigint, f1 bigint, f2 bigint, sig binary, bands array<bigint>")


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """After 40, 80 ... hashes: the fewest matches with a posterior P(similarity >= threshold) of at least miss, from a
    uniform prior. A byte also matches by chance, once in 256."""
    j = (np.arange(20_000) + 0.5) / 20_000
    p = j + (1 - j) / 256
    out = []
    for n in range(BATCH, len(_A) + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[j >= percent / 100].sum() >= miss * weight.sum():
                out.append(m)
                break
    return tuple(out)


def _plausible(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs a, b that the sequential comparison of their signatures leaves."""
    side = lambda x: sigs.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches):
        least = least_matches(percent, miss)
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint8).reshape(t.num_rows, -1) for k in (2, 3))
            alive, matches = np.arange(t.num_rows), np.zeros(t.num_rows, np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            yield pa.record_batch([t.column(0), t.column(1)], ["a", "b"]).take(pa.array(alive))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(lean(run), f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs a, b (stored) whose full sets are similar enough. Only texts of documents in pairs are shuffled, as long as
    the ids are few enough to be broadcast."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    own = _of(texts, ids)
    side = lambda x: own.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last_text, last_set = None, None
        for t in batches:
            good = []
            for i in range(t.num_rows):
                a, b = t.column(2)[i].as_py(), t.column(3)[i].as_py()
                if a != last_text:
                    last_text, last_set = a, shingle_sets([a.encode("utf-8", "surrogatepass")], size)[0]
                other = shingle_sets([b.encode("utf-8", "surrogatepass")], size)[0]
                shared = len(np.intersect1d(last_set, other, assume_unique=True))
                if 100 * shared >= percent * (len(last_set) + len(other) - shared):
                    good.append(i)
            yield pa.record_batch([t.column(0), t.column(1)], ["a", "b"]).take(pa.array(good, pa.int64()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(lean(run), f"a {kind}, b {kind}")


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ids (stored): map-side as long as the ids are few enough to be broadcast."""
    return texts.join(F.broadcast(ids) if ids.count() <= IDS else ids, "doc_id", "left_semi")


@lru_cache(maxsize=8)
def most_differences(percent: int, miss: float) -> int:
    """How many of SKETCH one-bit hashes may differ: more have a probability below miss at the threshold. Two bits differ
    if the hashes do, and then once in two."""
    p, chance, over = (1 - percent / 100) / 2, [], 0.0
    for k in range(SKETCH + 1):
        chance.append(math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k))
    for k in range(SKETCH, 0, -1):
        over += chance[k]
        if over >= miss:
            return k
    return 0


def _prefix_pairs(rest: DataFrame, texts: DataFrame, size: int, percent: int, miss: float, into: list) -> DataFrame:
    """rest (stored): doc_id, n, own. The pairs a, b of different components that can reach the threshold: of both sets,
    taken in the order of how many of these documents hold a shingle, the first part that the threshold allows to
    miss must have a shingle in common, and the places of the first common one bound what can be shared. Edits of
    copies being rare, they fill the first parts; a shingle that only one component has there gives no pairs. One-bit
    sketches drop pairs far below the threshold within the join."""

    def run(batches):
        for b in batches:
            for at, part in text_batches(b.column(1)):
                sets = shingle_sets(part, size)
                bits = [np.packbits(mix(signature(x).astype(_U)).astype(np.uint8)[:SKETCH] & 1).view(np.int64) for x in sets]
                yield pa.record_batch(
                    [b.column(0).slice(at, len(part)), pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64())),
                     *[pa.array([int(x[k]) for x in bits], pa.int64()) for k in range(3)]],
                    ["doc_id", "h", "s0", "s1", "s2"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    bits = ["s0", "s1", "s2"]
    sets = stored(_of(texts, rest.select("doc_id")).mapInArrow(lean(run), f"doc_id {kind}, h array<bigint>, s0 bigint, s1 bigint, s2 bigint"), "sets", into)
    each = sets.select("doc_id", *bits, F.explode("h").alias("h"))
    often = counted(each, "h", "df", 1, into)
    first = often.groupBy("doc_id", *bits).agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    allowed = F.size("s") - F.floor((F.size("s") * percent + 99) / 100).cast("int") + 1
    first = first.select("doc_id", *bits, F.posexplode(F.slice("s", F.lit(1), allowed)).alias("at", "e")).filter("e.df > 1")
    first = stored(first.select("doc_id", *bits, "at", "e.h").join(rest, "doc_id"), "prefixes", into)
    mixed = first.groupBy("h").agg(F.min("own").alias("x"), F.max("own").alias("y"), F.count("*").alias("c")).filter("x <> y")
    first = met(first, stored(mixed.select("h", "c"), "mixed", into), ["h"], "c")
    side = lambda x: first.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "own", "at", *bits)])
    differ = " + ".join(f"bit_count({k}_a ^ {k}_b)" for k in bits)
    pairs = side("a").join(side("b"), "h").filter(
        f"doc_id_a < doc_id_b AND own_a <> own_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        f" AND {100 + percent} * least(n_a - at_a, n_b - at_b) >= {percent} * (n_a + n_b) AND {differ} <= {most_differences(percent, miss)}"
    )
    return pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80,
            miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents whose shingle sets have a Jaccard similarity of at least
    percent / 100 are linked; a component's least id is kept."""
    steps: list[DataFrame] = []
    s = stored(signed(docs, id_col, text_col, shingle), "signed", steps)
    same = s.filter("f1 is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    same = stored(same.filter("c > 1"), "same")
    s = met(s, same, ["f1", "f2", "n"], "c", "left")
    s = stored(s.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), "sig", "bands"), "classes")
    reps = s.filter("doc_id = rep AND sig IS NOT NULL").drop("rep").dropDuplicates(["doc_id", "sig"])
    keys = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min("doc_id").alias("lead"), F.min_by("n", "doc_id").alias("n_lead"), F.count("*").alias("c"))
    full = stored(full.filter("c > 1"), "full", steps)
    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    rows = stored(met(keys, full, ["key"], "c"), "buckets", steps)
    texts = keyed(docs, id_col, text_col)

    def links(pairs: DataFrame, tag: str) -> DataFrame:
        left = stored(_plausible(pairs.distinct(), reps, percent, miss), f"{tag}-plausible", steps)
        return stored(_confirmed(left, texts, shingle, percent), f"{tag}-links", steps)

    first = rows.filter("doc_id <> lead").select(
        F.col("lead").alias("a"), F.col("doc_id").alias("b"), F.col("n_lead").alias("n_a"), F.col("n").alias("n_b")
    )
    found = links(first.filter(near).select("a", "b"), "lead")
    known = components(found, steps)
    labelled = rows.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", "n", "lead", F.coalesce("component", "doc_id").alias("own")
    )
    labelled = stored(labelled, "labelled", steps)
    mixed = labelled.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y"), F.count("*").alias("c")).filter("x <> y")
    rest = met(labelled, stored(mixed.select("key", "c"), "mixed", steps), ["key"], "c").filter("doc_id <> lead").select("doc_id", "n", "own")
    second = _prefix_pairs(stored(rest.dropDuplicates(["doc_id"]), "rest", steps), texts, shingle, percent, miss, steps)
    more = links(second, "rest")
    whole = components(found.unionByName(more), steps)
    sizes = same.groupBy("rep").agg(F.sum("c").alias("c"))
    whole = whole.withColumnRenamed("node", "rep").join(sizes, "rep", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    whole = stored(whole, "whole")
    discard(steps)
    out = met(s, whole, ["rep"], "c", "left")
    component = F.coalesce("component", "rep")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )


def op1(docs: DataFrame) -> DataFrame:
    return classes(docs, shingle=4)


def stage(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component, with all their columns. Rows without ids, or with equal ids, are
    documents of their own, ordered by id (null last) and text; of rows with equal ids and texts, one stays (all of
    them, if they have no words)."""
    rows, key, unique = told_apart(docs)
    drop = classes(rows, key).filter("NOT kept").select(F.col("doc_id").alias(key))
    left = rows.join(drop, key, "left_anti")
    if not unique:
        said = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        left = left.filter(said).dropDuplicates([key]).unionByName(left.filter(~said))
    return left.select(*columns(docs))


#: The same in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i FROM w) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
f AS (SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id)
SELECT *, component_id = doc_id AS kept FROM f
"""
