"""Media columns: GIF.

The decoder reads any GIF: it unpacks LZW code streams, applies global and local palettes, interlacing, transparency and
the disposal rules, and gives the composed picture of every timed frame. LZW is decoded without a loop over codes: each
code stands for a piece of what was decoded before, so lengths and bytes follow by pointer doubling.

The encoder stores bytes as 8-bit samples: frames of 24 columns with a grey palette, so sample and byte are equal.

Defined cases: a null or empty text is one block of padding; a null medium has no frames; repeated rows are handled one
by one; a broken or truncated stream raises ValueError in decode(); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, lean
from .hashing import text_batches

SIDE = 24
BLOCK = SIDE * SIDE
#: Blocks in a frame; longer payloads take more frames, so memory does not grow with them.
BLOCKS = 64
DELAY_CS = 10
#: Bins of each channel's histogram.
BINS = 16
_GREYS = bytes(x for i in range(256) for x in (i, i, i))


def _code_widths(n: int, least: int) -> np.ndarray:
    """Bits of the n codes after a clear code."""
    top = (1 << (least - 1)) + 1 + np.arange(n)
    return np.clip(np.floor(np.log2(top)).astype(np.int64) + 1, least, 12)


_WIDTHS = {x: _code_widths(4096, x) for x in range(3, 13)}


def lzw_encode(data: bytes) -> bytes:
    """GIF's LZW over 8-bit samples."""
    codes, counts = [256], [1]  # counts: codes from one clear to the next, the later clear included
    if data:
        table: dict[int, int] = {}
        get, put, new, at = table.get, codes.append, 258, 1
        prefix = data[0]
        for byte in memoryview(data)[1:]:
            key = prefix << 8 | byte
            code = get(key)
            if code is None:
                put(prefix)
                table[key] = new
                new += 1
                prefix = byte
                if new == 4096:
                    put(256)
                    table.clear()
                    new = 258
                    counts.append(len(codes) - at)
                    at = len(codes)
            else:
                prefix = code
        put(prefix)
        put(257)
        counts.append(len(codes) - at)
    else:
        codes.append(257)
        counts.append(1)
    widths = np.concatenate([_WIDTHS[9][:n] for n in counts])
    value = np.array(codes, np.int64)[:, None]
    bit = np.arange(12)
    return np.packbits((value >> bit & 1).astype(bool)[bit < widths[:, None]], bitorder="little").tobytes()


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples that the codes after one clear code stand for."""
    n = len(codes)
    parent = codes - (clear + 2)
    literal = codes < clear
    if n == 0:
        return np.zeros(0, np.uint8)
    if np.any(~literal & ((parent < 0) | (parent >= np.arange(n)))):
        raise ValueError("an LZW code before its string")
    up = np.where(literal, np.arange(n), parent)
    length = (~literal).astype(np.int64)
    while True:
        further = up[up]
        length = length + length[up]
        if np.array_equal(further, up):
            break
        up = further
    length += 1
    start = np.cumsum(length) - length
    back = np.where(literal, 0, start - start[np.where(literal, 0, parent)])
    source = np.arange(int(length.sum())) - np.repeat(back, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    samples = np.zeros(len(source), np.uint8)
    samples[start[literal]] = codes[literal]
    return samples[source]


def lzw_decode(data: bytes, code_size: int, most: int) -> np.ndarray:
    """Up to `most` samples."""
    clear = 1 << code_size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, out, got = 8 * len(data), 0, [], 0
    table = _WIDTHS[code_size + 1]
    while got < most:
        parts = []
        ended = False
        done = 0
        while True:
            widths = table[done : done + 4096] if done < 4096 else np.full(4096, 12)
            offset = at + np.cumsum(widths) - widths
            ok = int(np.searchsorted(offset + widths, bits, "right"))
            offset, widths = offset[:ok], widths[:ok]
            byte = offset >> 3
            codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offset & 7) & ((1 << widths) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop):
                k = int(stop[0])
                parts.append(codes[:k])
                at = int(offset[k] + widths[k])
                ended = codes[k] == clear + 1
                break
            parts.append(codes)
            if ok < 4096 and (ok < len(table) - done or done >= 4096):
                ended = True
                break
            done += ok
            at = int(offset[-1] + widths[-1])
        samples = _expand(np.concatenate(parts), clear)
        out.append(samples)
        got += len(samples)
        if ended:
            break
    return np.concatenate(out)[:most] if out else np.zeros(0, np.uint8)


@dataclass
class Frame:
    """A timed frame: its place, the whole picture (height, width, RGBA) after it is drawn, its samples and colours, and
    whether it covers all of its place."""

    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    picture: np.ndarray
    samples: np.ndarray
    colours: np.ndarray
    opaque: bool


def encode(payload: bytes) -> bytes:
    """A GIF with the payload (a positive multiple of BLOCK bytes) as its samples."""
    if not payload or len(payload) % BLOCK:
        raise ValueError(f"the payload must be a positive multiple of {BLOCK} bytes")
    two = lambda x: x.to_bytes(2, "little")
    step = BLOCK * BLOCKS
    out = [b"GIF89a", two(SIDE), two(min(len(payload), step) // SIDE), b"\xf7\0\0", _GREYS]
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        out += [b"\x21\xf9\x04\x04", two(DELAY_CS), b"\0\0", b"\x2c\0\0\0\0", two(SIDE), two(len(part) // SIDE), b"\0\x08"]
        data = lzw_encode(part)
        for k in range(0, len(data), 255):
            block = data[k : k + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def decode(data: bytes):
    """Yields each Frame of a GIF."""
    try:
        yield from _decode(data)
    except IndexError as e:
        raise ValueError("the GIF ends early") from e


def _decode(data: bytes):
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    number = lambda i: data[i] | data[i + 1] << 8
    palette = lambda i, n: np.frombuffer(data, np.uint8, 3 * n, i).reshape(n, 3)
    canvas = np.zeros((number(8), number(6), 4), np.uint8)
    at, common = 13, None
    if data[10] & 0x80:
        n = 2 << (data[10] & 7)
        common, at = palette(at, n), at + 3 * n
    delay, disposal, clear_index = 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                flags, delay = data[at + 3], number(at + 4)
                disposal, clear_index = flags >> 2 & 7, data[at + 6] if flags & 1 else None
            _, at = _blocks(data, at + 2)
            continue
        if kind != 0x2C:
            raise ValueError("an unknown GIF block")
        left, top, width, height, flags = number(at + 1), number(at + 3), number(at + 5), number(at + 7), data[at + 9]
        at += 10
        colours = common
        if flags & 0x80:
            n = 2 << (flags & 7)
            colours, at = palette(at, n), at + 3 * n
        code_size = data[at]
        if not 2 <= code_size <= 8 or colours is None:
            raise ValueError("a bad code size, or no palette")
        packed, at = _blocks(data, at + 1)
        samples = lzw_decode(packed, code_size, width * height)
        if len(samples) < width * height:
            raise ValueError("too few samples")
        samples = samples.reshape(height, width)
        if flags & 0x40:
            rows = [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]
            plain = np.empty_like(samples)
            plain[rows] = samples
            samples = plain
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + height, left : left + width]
        samples = samples[: area.shape[0], : area.shape[1]]
        full = np.zeros((256, 4), np.uint8)
        full[: len(colours), :3] = colours
        full[:, 3] = 255
        drawn = full[samples]
        if clear_index is None:
            area[:] = drawn
        else:
            seen = samples != clear_index
            area[seen] = drawn[seen]
        yield Frame(left, top, width, height, delay, canvas.copy(), samples, full[:, :3], clear_index is None)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def histogram(frame: Frame) -> np.ndarray:
    """The colours of the frame's own area after it is drawn: for red, green and blue, the visible pixels in BINS bins."""
    if frame.opaque:  # what is seen are the samples: each colour of the palette is looked at once
        times = np.bincount(frame.samples.ravel(), minlength=256)
        colours = frame.colours
    else:
        own = frame.picture[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
        colours = own[own[..., 3] > 0][:, :3]
        times = np.ones(len(colours), np.int64)
    bins = colours.astype(np.int64) * BINS // 256
    return np.stack([np.bincount(bins[:, c], weights=times, minlength=BINS) for c in range(3)]).astype(np.int64)


def timed(raw: bytes):
    """Yields each frame of a GIF with its number, start in ms and histogram."""
    ms = 0
    for n, f in enumerate(decode(raw)):
        yield n, ms, f, histogram(f)
        ms += 10 * f.delay_cs


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded, as a GIF."""
    d = keyed(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            for at, part in text_batches(b.column(1)):
                media = pa.array([encode(payload_of(x)) for x in part], pa.binary())
                yield pa.record_batch([b.column(0).slice(at, len(part)), pa.array([len(x) for x in part], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return d.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame: doc_id, frame, start_ms, delay_ms, left, top, width, height, red, green, blue (histograms of
    the visible pixels) and samples (the drawn picture of the frame's own area, RGBA, row by row). Frames are handed on
    one at a time, so a long medium takes no more memory than a short one."""
    d = media.select(media[id_col].alias("doc_id"), media[media_col].alias("media"))
    ints = ["frame", "start_ms", "delay_ms", "left", "top", "width", "height"]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                raw = b.column(1)[k].as_py()
                for n, ms, f, bins in timed(raw) if raw is not None else ():
                    own = f.picture[f.top : f.top + f.height, f.left : f.left + f.width]
                    numbers = [n, ms, 10 * f.delay_cs, f.left, f.top, f.width, f.height]
                    yield pa.record_batch(
                        [b.column(0).slice(k, 1), *[pa.array([x], pa.int64()) for x in numbers], *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in bins],
                         pa.array([own.tobytes()], pa.binary())],
                        ["doc_id", *ints, "red", "green", "blue", "samples"],
                    )

    kind = d.schema["doc_id"].dataType.simpleString()
    whole = ", ".join(f"{c} bigint" for c in ints)
    return d.mapInArrow(lean(run), f"doc_id {kind}, {whole}, red array<bigint>, green array<bigint>, blue array<bigint>, samples binary")


def op3(docs: DataFrame) -> DataFrame:
    """Digests of what the stored GIFs hold; a medium is decoded frame by frame, and only its digests stay."""
    media = stored_media(docs)

    def run(batches):
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                raw = b.column(2)[k].as_py()
                digest, size, tail, end, hist = hashlib.sha256(), 0, b"", 0, np.zeros((3, BINS), np.int64)
                n = -1
                for n, ms, f, bins in timed(raw):
                    samples = f.picture[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()  # grey: red is the sample
                    digest.update(samples)
                    size, tail, end = size + len(samples), (tail + samples)[-32:], ms + 10 * f.delay_cs
                    hist += bins
                said = ";".join(f"{c}={','.join(map(str, h))}" for c, h in zip(("red", "green", "blue"), hist.tolist(), strict=True))
                rows.append((size, digest.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), f"frames={n + 1};ms={end};{said}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([b.column(0), b.column(1), *columns],
                                  ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
