"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic text, and the
difference of the lengths that each window of a text is compressed to with them.

Most of a toxic document is ordinary, so a dictionary trained on all its windows learns mostly ordinary text. The toxic
dictionary is therefore trained in rounds, on the halves of the labelled toxic documents: a dictionary of one half's windows
picks from the other half those that it shortens by more than the ordinary dictionary does; how many bytes more, is set
so that only STRAY of ordinary windows are picked. The next round trains on the windows picked. A dictionary may be grown by
pieces, each trained on the windows that the pieces before don't shorten, so that frequent passages don't fill it. Which
schedule of rounds and how many pieces serve best, labelled documents decide that trained no dictionary. No words are
chosen by hand or by counts: zstandard's trainer picks what the dictionaries hold.

A reader of toxic text knows ordinary text, too: windows are compressed with the toxic dictionary in front of the ordinary one,
and, for comparison, with zeros of the same length in its place. The bytes that a window saves, counted by thresholds, are
the inputs of a logistic function, fitted on those further documents.

The model is fitted on the driver on at most TOXIC + ORDINARY labelled documents (the least by a hash of their id), so its
cost does not grow with the number of documents; learning and scoring read whole texts, scoring in one pass without a
shuffle. The level of STRAY is measured on CONTROL ordinary windows, spread evenly over all.

Defined cases: a null or empty text has no savings and gets the score of a text without toxic windows; without two
labelled toxic and ordinary documents (an empty table, too) all scores are 0; a null id counts as not held out; repeated
rows are scored one by one; a document's label is the largest of its labels, null ones and those without id are not learnt
from; of rows with equal ids the least text is learnt from; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, lean

#: Labelled documents to learn from, at most.
TOXIC, ORDINARY = 1000, 3000
#: Ordinary windows that the level of picked ones is measured on, and the share of them that may be picked.
CONTROL, STRAY = 60_000, 0.001
#: Bytes after which a window ends with the next word.
WINDOW = 16
ORDINARY_BYTES = 112_000
#: The toxic dictionary has so much room; size and length of the trainer's segments of one trained as a whole, by round
#: and schedule (None: one grown by pieces).
ROOM = 4096
SCHEDULES = (((4096, 12), (4096, 12), (2048, 12)), ((4096, 12), None, None))
#: Size and segments of a piece, the bytes saved from which on a window is served by the pieces before, and the numbers of
#: pieces tried for the last dictionary.
PIECE, SERVED = (256, 12), 2
PIECES = (4, 6, 8)
#: Bytes saved from which on a window counts.
LEVELS = (1, 2, 3, 4)

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


def windows(text: str) -> list[bytes]:
    """The text in lower case, cut after a word every WINDOW bytes or so; any white space is a space."""
    t = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACES)
    out, n, i = [], len(t), 0
    while i < n:
        j = t.find(b" ", i + WINDOW, i + 4 * WINDOW)
        if j < 0:
            j = min(n, i + 4 * WINDOW)
        out.append(t[i : j + 1])
        i = max(j, i + 1)
    return out


def trained(size: int, segment: int, samples: list[bytes]) -> bytes:
    """A dictionary by zstandard's trainer; of too few samples, their end."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].rjust(64)


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    import zstandard

    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY, **plain
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)


def _lengths(content: bytes, parts: list[bytes], threads: int = 1) -> np.ndarray:
    compressor, out = _compressor(content), []
    for i in range(0, len(parts), 4000):
        done = compressor.multi_compress_to_buffer(parts[i : i + 4000], threads=threads)
        out += [len(done[k]) for k in range(len(done))]
    return np.array(out, np.int64)


def _content(ordinary: bytes, toxic: bytes) -> bytes:
    return toxic.rjust(ROOM, b"\0") + b"\0" * 16 + ordinary


def _framed(ordinary: bytes, parts: list[bytes]) -> list[bytes]:
    """Around each window: a match that every window has, so no window pays for its first one, and an end."""
    return [ordinary[300:324] + w + b"\1" * 8 for w in parts]


class Windows:
    """Windows with their lengths by the ordinary dictionary, to be tried with many toxic ones."""

    def __init__(self, ordinary: bytes, parts: list[bytes]):
        self.ordinary, self.parts, self.framed = ordinary, parts, _framed(ordinary, parts)
        self.plain = _lengths(_content(ordinary, b""), self.framed, 4)

    def saved(self, toxic: bytes) -> np.ndarray:
        """How many bytes shorter each window becomes by the toxic dictionary."""
        return self.plain - _lengths(_content(self.ordinary, toxic), self.framed, 4)

    def grown(self, pieces: int):
        """Dictionaries of these windows, by one piece more each time."""
        out, rest = b"", self.parts
        framed, plain = self.framed, self.plain
        for _ in range(pieces):
            out = trained(*PIECE, rest) + out
            yield out
            served = plain - _lengths(_content(self.ordinary, out), framed, 4) >= SERVED
            keep = np.flatnonzero(~served).tolist()
            if len(keep) < 20:
                return
            rest, framed, plain = [rest[i] for i in keep], [framed[i] for i in keep], plain[keep]


def _features(saved: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For texts of so many windows each, and for each of LEVELS: whether a window saves so much, how many do, and their
    share; and the largest saving."""
    out, at = np.zeros((len(sizes), 3 * len(LEVELS) + 1)), 0
    for k, size in enumerate(sizes):
        d = saved[at : at + size]
        at += size
        row = []
        for v in LEVELS:
            n = int((d >= v).sum())
            row += [float(n > 0), math.log1p(n), n / size]
        out[k] = [*row, max(int(d.max()), 0) / 8]
    return out


class Model:
    """The two dictionaries and the calibration; small, so it travels with the tasks."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: list[float] | None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def features(self, texts: list[str]) -> np.ndarray:
        parts = [windows(t) for t in texts]
        framed = _framed(self.ordinary, [w for p in parts for w in p])
        saved = _lengths(_content(self.ordinary, b""), framed) - _lengths(_content(self.ordinary, self.toxic), framed)
        return _features(saved, [len(p) for p in parts])

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.zeros(len(texts)) if self.weights is None else self.scores_of(self.features(texts))

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        z = x @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's steps of a ridge logistic regression; the ordinary class as a whole weighs three times the toxic one."""
    x = np.hstack([x, np.ones((len(x), 1))])
    each = np.where(y == 1, 0.25 / max(y.sum(), 1), 0.75 / max((1 - y).sum(), 1))
    ridge = 1e-3 * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (each * (p - y)) + ridge @ w)
    return w


def _spread(parts: list, most: int) -> list:
    """At most so many, evenly over all."""
    n = len(parts)
    return parts if n <= most else [parts[(2 * k + 1) * n // (2 * most)] for k in range(most)]


def _distinct(texts: list[str]) -> tuple[list[bytes], list[bytes]]:
    """The distinct windows of either half of the texts. Those that both have are left out, so that copies of a text in
    both halves, which compress well by each other, don't look like what one class has in common; and no window counts
    twice, as the trainer stops early on text that repeats."""
    half = (len(texts) + 1) // 2
    parts = [dict.fromkeys(w for t in p for w in windows(t)) for p in (texts[:half], texts[half:])]
    both = parts[0].keys() & parts[1].keys()
    return tuple([w for w in p if w not in both] or list(p) for p in parts)


def toxic_windows(halves: tuple[Windows, Windows], control: Windows, schedule: tuple) -> list[bytes]:
    """The windows of both halves that are left after the rounds: each round, the dictionary of one half's picks from the
    other half."""
    picked = halves
    for kind in schedule:
        judges = [trained(*kind, p.parts) if kind else [*p.grown(max(PIECES))][-1] for p in picked]
        now = []
        for k in (0, 1):
            stray = np.sort(control.saved(judges[1 - k]))[::-1]
            level = max(1, int(stray[int(STRAY * len(stray))]) + 1) if len(stray) else 1
            good = np.flatnonzero(halves[k].saved(judges[1 - k]) >= level).tolist()
            now.append([halves[k].parts[i] for i in good])
        if min(map(len, now)) < 20:
            break
        picked = tuple(Windows(halves[0].ordinary, p) for p in now)
    return picked[0].parts + picked[1].parts


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts; two thirds train the dictionaries, the rest calibrates and chooses."""
    bad, good = ([t for t, y in zip(texts, toxic, strict=True) if y == k] for k in (1, 0))
    if len(bad) < 2 or len(good) < 2:
        return Model(b" " * 400, b"", None)
    cut = lambda x: (x[: max(1, 2 * len(x) // 3)], x[max(1, 2 * len(x) // 3) :])
    (bad, bad_rest), (good, good_rest) = cut(bad), cut(good)
    ordinary, control = _distinct(good)
    base = trained(ORDINARY_BYTES, 24, ordinary).ljust(400)
    first, second = _distinct(bad)
    halves = Windows(base, first), Windows(base, second or first)
    control = Windows(base, _spread(control, CONTROL))
    rest = [windows(t) for t in bad_rest + good_rest]
    sizes, rest = [len(p) for p in rest], Windows(base, [w for p in rest for w in p])
    y = np.array([1.0] * len(bad_rest) + [0.0] * len(good_rest))
    best = None
    for schedule in SCHEDULES:
        pool = Windows(base, toxic_windows(halves, control, schedule))
        grown = [*pool.grown(max(PIECES))]
        for content in {min(n, len(grown)): grown[min(n, len(grown)) - 1] for n in PIECES}.values():
            x = _features(rest.saved(content), sizes)
            model = Model(base, content, _logistic(x, y).tolist())
            hit = model.scores_of(x) >= 0.5
            value = hit[y == 1].mean() - 3 * hit[y == 0].mean()
            if best is None or value > best[0]:
                best = value, model
    return best[1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From labelled rows whose crc32(id) mod 5 is not 0."""
    l = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("toxic")).filter("doc_id IS NOT NULL")
    l = l.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = l.filter("toxic = 1").orderBy(*order).limit(TOXIC).unionByName(l.filter("toxic = 0").orderBy(*order).limit(ORDINARY))
    # at most TOXIC + ORDINARY rows are broadcast and gathered
    d = keyed(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = d.orderBy(*order).collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score."""
    d = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 50):
                part = b.slice(i, 50)
                score = model.scores(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return d.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored(docs, train(docs, labels)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
