"""Substring dedup with suffix automata of reference shards.

A word goes if a window of `size` words covers it whose words also start earlier: in a document of smaller id, or earlier
in the same one.

1. One pass winnows every document: of the 8-word grams in each window, the one with the least hash is the window's
   anchor. Equal windows have equal anchors, so a window can repeat only if its anchor does. Only anchors (about one for
   seven words) are shuffled and counted. Whole copies of a document need no more than their fingerprint.
2. Documents with repeated anchors are read once more; around each such anchor they give a segment: the words of all
   windows that it anchors. Equal segments are one from here on, with their earliest place.
3. If the distinct segments have BROADCAST words or fewer, they are one reference shard: its suffix automaton, built in
   the order of places, so each state knows the earliest one, is broadcast, and documents stream past it. The matching
   statistics, cut at `size` words, give the earliest place of every window.
4. Beyond that size, the automata (some 0.4 kB for each word) would not fit into every worker, and documents would have to
   stream past all shards in turn. So the segments are dealt to reference shards by anchor, every place of a window being
   in one shard of bounded size: anchors with very many places give a segment for each window, dealt by the window as well.
   A task builds its shard's automaton and streams the shard's segments through it.
5. Windows that start earlier elsewhere are marked in all documents that have them, and the covered words go.

Defined cases: a null or empty text has no words; a document with a null id is left as it is and is no reference; rows
with equal ids and equal texts are one document; rows with equal ids and other texts are documents of equal rank, none
earlier than the other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, counted, discard, freed, fresh, keyed, lean, met, release, stored, told_apart
from .hashing import mix, runs, spans, text_batches, words

SIZE, GRAM = 20, 8
#: Segments that a shard holds on average, and the places from which on an anchor is dealt by window.
SHARD, HEAVY = 4000, 20_000
#: Words of distinct segments whose automaton is broadcast.
BROADCAST = 60_000
_U = np.uint64


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    place = mix(np.arange(1, len(h) + 1, dtype=_U))
    return int((h * (place | _U(1))).sum(dtype=_U).astype(np.int64)), int(mix(h + place).sum(dtype=_U).astype(np.int64))


def _anchors(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and for each window the place of its anchor."""
    grams = runs(h, GRAM)
    if len(h) < size:
        return grams, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, size - GRAM + 1)
    return grams, np.arange(len(view)) + view.argmin(axis=1)


def _runs_of(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run with the same anchor."""
    edge = np.flatnonzero(np.diff(anchor)) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge - 1, [len(anchor) - 1]])


def _scanned(d: DataFrame, size: int) -> DataFrame:
    """doc_id, n_words, f1, f2 (a fingerprint of the words), whole (the digest if nothing goes), anchors."""

    def run(batches):
        for b in batches:
            for at, part in text_batches(b.column(1)):
                h, _, _, first = words(part)
                n, f1, f2, whole, found = [], [], [], [], []
                for k, text in enumerate(part):
                    own = h[first[k] : first[k + 1]]
                    a, c = _fingerprint(own)
                    n.append(len(own)), f1.append(a), f2.append(c)
                    whole.append(_digest(text.split()))
                    grams, anchor = _anchors(own, size)
                    found.append(grams[np.unique(anchor)].astype(np.int64) if len(anchor) else np.zeros(0, np.int64))
                yield pa.record_batch(
                    [b.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.array(whole, pa.string()), pa.array(found, pa.list_(pa.int64()))],
                    ["doc_id", "n_words", "f1", "f2", "whole", "anchors"],
                )

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(run), f"doc_id {kind}, n_words bigint, f1 bigint, f2 bigint, whole string, anchors array<bigint>")


def _digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _segments(d: DataFrame, size: int, shards: int) -> DataFrame:
    """d: doc_id, text, f1, f2 and hot (structs of a repeated anchor h and whether it is heavy). Gives, for each run of
    windows with a repeated anchor: doc_id, f1, f2, start (its first word), k1, k2 (the segment's key), shard, size (words), segment."""

    def run(batches):
        for b in batches:
            hots = b.column(4)
            for at, part in text_batches(b.column(1)):
                h, _, _, first = words(part)
                rows = []
                for k, text in enumerate(part):
                    own = h[first[k] : first[k + 1]]
                    f1, f2 = _fingerprint(own)
                    if (f1, f2) != (b.column(2)[at + k].as_py(), b.column(3)[at + k].as_py()):
                        continue  # another text with the same id
                    hot = hots[at + k].values
                    keys = hot.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    heavy = dict(zip(keys.tolist(), hot.field(1).to_pylist(), strict=True))
                    grams, anchor = _anchors(own, size)
                    low, high = _runs_of(anchor)
                    signed = grams[anchor[low]].astype(np.int64)
                    pick = np.isin(signed, keys)
                    low, high, signed = low[pick], high[pick], signed[pick]
                    dense = np.array([heavy[g] for g in signed.tolist()], bool)
                    if dense.any():  # a segment for each window
                        times = np.where(dense, high - low + 1, 1)
                        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        low, signed, dense = np.repeat(low, times) + step, np.repeat(signed, times), np.repeat(dense, times)
                        high = np.where(dense, low, np.repeat(high, times))
                    k1 = spans(own, low, high + size).astype(np.int64)
                    k2 = spans(mix(own + _U(1)), low, high + size).astype(np.int64)
                    shard = (mix(np.where(dense, signed ^ k1, signed).astype(_U)) % _U(shards)).astype(np.int64)
                    split = text.split()
                    for x, y, *key in zip(low.tolist(), high.tolist(), k1.tolist(), k2.tolist(), shard.tolist(), strict=True):
                        rows.append((at + k, f1, f2, x, *key, y - x + size, b" ".join(split[x : y + size])))
                if rows:
                    c = list(zip(*rows, strict=True))
                    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.binary()]
                    columns = [pa.array(v, t) for v, t in zip(c, kinds, strict=True)]
                    yield pa.record_batch([b.column(0).take(columns[0]), *columns[1:]],
                                          ["doc_id", "f1", "f2", "start", "k1", "k2", "shard", "size", "segment"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.select("doc_id", "text", "f1", "f2", "hot").mapInArrow(lean(run), f"doc_id {kind}, f1 bigint, f2 bigint, start bigint, k1 bigint, k2 bigint, shard int, size int, segment binary")


class Automaton:
    """A suffix automaton over sequences of words; each state keeps the place where it first ended."""

    def __init__(self):
        self.next, self.link, self.length, self.place = [{}], [-1], [0], [None]

    def add(self, sequence: list, places: list) -> None:
        """One more sequence; places: what to keep for each end."""
        nexts, link, length, place = self.next, self.link, self.length, self.place
        last = 0
        for word, at in zip(sequence, places, strict=True):
            q = nexts[last].get(word)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, word, q)
                continue
            cur = len(nexts)
            nexts.append({}), link.append(0), length.append(length[last] + 1), place.append(at)
            p = last
            while p != -1 and word not in nexts[p]:
                nexts[p][word] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][word]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, word, q)
            last = cur

    def _clone(self, p: int, word, q: int) -> int:
        nexts, link, length, place = self.next, self.link, self.length, self.place
        new = len(nexts)
        nexts.append(dict(nexts[q])), link.append(link[q]), length.append(length[p] + 1), place.append(place[q])
        link[q] = new
        while p != -1 and nexts[p].get(word) == q:
            nexts[p][word] = new
            p = link[p]
        return new

    def earliest(self, sequence: list, size: int) -> list:
        """Streams a sequence; for each end, what the first end of the last `size` words keeps (None if the matching
        statistic is shorter)."""
        nexts, link, length, place = self.next, self.link, self.length, self.place
        out, state, matched = [], 0, 0
        for word in sequence:
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                matched += 1
            while length[link[state]] >= size if state else False:
                state = link[state]
                matched = min(matched, length[state])
            out.append(place[state] if matched >= size else None)
            if matched > size:
                matched = size
        return out


def automaton_of(rows: list[tuple], size: int) -> Automaton:
    """rows: id, first word's place and words of distinct segments; each state keeps its earliest id and place."""
    out = Automaton()
    for doc, start, segment in sorted(rows, key=lambda r: (_plain(r[0]), r[1])):
        split = segment.split(b" ")
        out.add(split, [(doc, start + k + 1 - size) for k in range(len(split))])
    return out


def shard_places(rows: list[tuple], size: int) -> list[list[tuple]]:
    """For each of the rows (see automaton_of), the earliest id and place of its windows."""
    automaton = automaton_of(rows, size)
    return [automaton.earliest(segment.split(b" "), size)[size - 1 :] for _, _, segment in rows]


def _located(distinct: DataFrame, size: int) -> DataFrame:
    """distinct: shard, k1, k2, doc_id, start, segment. Gives k1, k2 and the earliest ids and starts of its windows."""

    def run(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_pylist() for c in ("k1", "k2", "doc_id", "start", "segment")}
        found = shard_places(list(zip(rows["doc_id"], rows["start"], rows["segment"], strict=True)), size)
        release()
        return pa.table({
            "k1": pa.array(rows["k1"], pa.int64()), "k2": pa.array(rows["k2"], pa.int64()),
            "ids": pa.array([[x[0] for x in f] for f in found], pa.list_(table.schema.field("doc_id").type)),
            "starts": pa.array([[x[1] for x in f] for f in found], pa.list_(pa.int64())),
        })

    kind = distinct.schema["doc_id"].dataType.simpleString()
    return distinct.groupBy("shard").applyInArrow(run, f"k1 bigint, k2 bigint, ids array<{kind}>, starts array<bigint>")


def _plain(x):
    """An id that can be ordered: a struct as a tuple."""
    return tuple(x.values()) if isinstance(x, dict) else x


def _streamed(d: DataFrame, distinct: DataFrame, size: int, with_text: bool) -> DataFrame:
    """Documents (doc_id, text, f1, f2) past the broadcast automaton of all distinct segments: what _cut gives, for those
    that lose words. The caller has checked that the segments are few."""
    rows = [(_plain(r[0].asDict() if hasattr(r[0], "asDict") else r[0]), r[1], bytes(r[2])) for r in distinct.select("doc_id", "start", "segment").collect()]
    shared = d.sparkSession.sparkContext.broadcast(automaton_of(rows, size))

    def run(batches):
        automaton = shared.value
        for b in batches:
            out = [[], [], [], [], []]
            for i in range(b.num_rows):
                text = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                f1, f2 = (b.column(k)[i].as_py() for k in (2, 3))
                if _fingerprint(words([text])[0]) != (f1, f2):
                    continue  # another text with the same id
                own, split = _plain(b.column(0)[i].as_py()), text.split()
                gone = np.zeros(len(split) + 1, np.int64)
                for k, place in enumerate(automaton.earliest(split, size)[size - 1 :]):
                    if place is not None and place < (own, k):
                        gone[k] += 1
                        gone[k + size] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                if stays.all():
                    continue
                kept = [w for w, s in zip(split, stays.tolist(), strict=True) if s]
                for c, v in zip(out, (i, f1, f2, int((~stays).sum()), b" ".join(kept).decode("utf-8", "surrogatepass") if with_text else _digest(kept)), strict=True):
                    c.append(v)
            yield pa.record_batch([b.column(0).take(pa.array(out[0], pa.int32())), *[pa.array(c, pa.int64()) for c in out[1:4]],
                                   pa.array(out[4], pa.string())], ["doc_id", "f1", "f2", "n_removed", "kept"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.select("doc_id", "text", "f1", "f2").mapInArrow(lean(run), f"doc_id {kind}, f1 bigint, f2 bigint, n_removed bigint, kept string")


def _cut(d: DataFrame, size: int, with_text: bool) -> DataFrame:
    """d: doc_id, text, f1, f2 and windows (starts of windows to remove). Gives doc_id, f1, f2, n_removed and kept (the
    words left, or their digest)."""

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for i in range(b.num_rows):
                text = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                h, _, _, _ = words([text])
                f1, f2 = _fingerprint(h)
                if (f1, f2) != (b.column(2)[i].as_py(), b.column(3)[i].as_py()):
                    continue
                gone = np.zeros(len(h) + 1, np.int64)
                starts = b.column(4)[i].values.to_numpy(zero_copy_only=False)
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + size, -1)
                stays = np.cumsum(gone)[:-1] == 0
                kept = [w for w, s in zip(text.split(), stays.tolist(), strict=True) if s]
                for c, v in zip(out, (i, f1, f2, int((~stays).sum()), b" ".join(kept).decode("utf-8", "surrogatepass") if with_text else _digest(kept)), strict=True):
                    c.append(v)
            yield pa.record_batch([b.column(0).take(pa.array(out[0], pa.int32())), *[pa.array(c, pa.int64()) for c in out[1:4]],
                                   pa.array(out[4], pa.string())], ["doc_id", "f1", "f2", "n_removed", "kept"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.select("doc_id", "text", "f1", "f2", "windows").mapInArrow(lean(run), f"doc_id {kind}, f1 bigint, f2 bigint, n_removed bigint, kept string")


def _marked(parts: DataFrame, distinct: DataFrame, size: int, into: list) -> DataFrame:
    """doc_id, f1, f2 and windows (the starts of those that start earlier elsewhere), by the automata of dealt shards; into
    gets what it reads."""
    located = stored(_located(distinct, size), "located", into)
    placed = parts.select("doc_id", "f1", "f2", "start", "k1", "k2").join(located, ["k1", "k2"])
    starts = F.filter(
        F.transform(
            "ids",
            lambda x, k: F.when(
                (x < F.col("doc_id")) | ((x == F.col("doc_id")) & (F.get("starts", k) < F.col("start") + k)), F.col("start") + k
            ),
        ),
        lambda x: x.isNotNull(),
    )
    gone = placed.select("doc_id", "f1", "f2", starts.alias("w")).filter(F.size("w") > 0)
    return gone.groupBy("doc_id", "f1", "f2").agg(F.flatten(F.collect_list("w")).alias("windows"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, with_text: bool = False) -> DataFrame:
    """doc_id, f1, f2, n_words, n_removed and kept: the digest of the words left, joined by spaces, or these words
    themselves (null where nothing goes). One row for each row of docs."""
    d = keyed(docs, id_col, text_col)
    early: list[DataFrame] = []
    steps: list[DataFrame] = []
    scan = stored(_scanned(d, size), "scanned", early)
    real = scan.filter(F.col("doc_id").isNotNull())
    same = real.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1")
    scan = met(scan, stored(same, "same", early), ["f1", "f2"], "c", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)))
    anchors = scan.filter("doc_id IS NOT NULL AND NOT copy").select("doc_id", "f1", "f2", F.explode("anchors").alias("h"))
    again = counted(anchors, "h", into=early).withColumn("heavy", F.col("count") > HEAVY)
    hot = again.groupBy("doc_id", "f1", "f2").agg(F.collect_set(F.struct("h", "heavy")).alias("hot"))
    hot = stored(hot, "hot", steps)
    scan = stored(scan.drop("anchors", "rep"), "plain")
    discard(early)
    shards = max(1, (hot.agg(F.sum(F.size("hot"))).first()[0] or 0) // SHARD)
    parts = stored(_segments(d.join(hot, "doc_id"), size, shards), "segments", steps)
    distinct = parts.groupBy("shard", "k1", "k2").agg(
        F.min(F.struct("doc_id", "start")).alias("at"), F.any_value("segment").alias("segment"), F.count("*").alias("c")
    )
    distinct = distinct.select("shard", "k1", "k2", "at.doc_id", "at.start", "segment")
    with freed(d.sparkSession):
        total = parts.groupBy("k1", "k2").agg(F.any_value("size").alias("size")).agg(F.sum("size")).first()[0] or 0
    if total <= BROADCAST:
        ids = hot.select("doc_id", "f1", "f2")
        cut = _streamed(d.join(ids, "doc_id"), distinct, size, with_text)
    else:
        late: list[DataFrame] = []
        marked = stored(_marked(parts, distinct, size, steps), "marked", late)
        discard(steps)  # before all texts are shuffled once more
        steps = late
        cut = _cut(d.join(marked, "doc_id"), size, with_text)
    cut = stored(cut.dropDuplicates(["doc_id", "f1", "f2"]), "cut")
    discard(steps)
    out = scan.join(cut, ["doc_id", "f1", "f2"], "left")
    all_gone = F.col("copy") & (F.col("n_words") >= size)
    nothing = F.lit("") if with_text else F.lit(_digest([]))
    stays = F.lit(None).cast("string") if with_text else F.col("whole")
    return out.select(
        "doc_id",
        "f1",
        "f2",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(all_gone, nothing).otherwise(F.coalesce("kept", stays)).alias("kept"),
    )


def op8(docs: DataFrame) -> DataFrame:
    return removed(docs).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """All documents that keep a word, repeated passages removed from their texts; a text that loses nothing stays as it
    is, of others the words left are joined by spaces. Documents without words stay. Rows without ids, or with equal
    ids, are documents of their own, ordered by id (null last) and text; rows with equal ids and texts are one document,
    all of whose rows stay."""
    rows, key, _ = told_apart(docs)
    name = fresh(rows, "cut_text")
    r = removed(rows, key, with_text=True).filter("n_removed > 0").dropDuplicates(["doc_id"])
    r = r.select(F.col("doc_id").alias(key), F.struct("kept", (F.col("n_removed") < F.col("n_words")).alias("some")).alias(name))
    joined = rows.join(r, key, "left").filter(F.coalesce(F.col(name)["some"], F.lit(True)))
    kept = F.col(name)["kept"]
    new = {"text": F.coalesce(kept, F.col("text")), "n_chars": F.when(kept.isNotNull(), F.char_length(kept).cast("bigint"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(new["n_chars"], F.col("n_chars").cast("bigint"))
    return joined.select(*[new[c].alias(c) if c in new else column for c, column in zip(docs.columns, columns(docs), strict=True)])


#: The same in DuckDB's SQL.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM a),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, count(r.p) AS n_removed, string_agg(x, ' ' ORDER BY p.p) FILTER (r.p IS NULL) AS kept
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.p = r.p GROUP BY p.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
