"""[op 5] Media columns: baseline JPEG, decoded as far as the DC terms.

:func:`decode` parses the markers, Huffman-decodes the scan and rebuilds the
luminance thumbnail of block means. Restart intervals of all images that
share tables are decoded side by side in numpy. AC terms are decoded only to
step over them.

:func:`encode` stores bytes as the means of flat 8x8 blocks, with a quantizer
of 8 for the DC term, so that the thumbnail gives back each byte exactly.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from deltaloom.llm.frames import annotate

#: Bytes in a row of blocks, which is also a restart interval; rows of an image (a longer payload takes several).
WIDTH, ROWS = 64, 8_128

#: Code lengths and symbols of the usual luminance DC table; the AC table has the end of block only.
DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
AC_LENGTHS, AC_SYMBOLS = [1] + [0] * 15, [0]


def _codes(lengths: Sequence[int], symbols: Sequence[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length), as canonical codes are dealt out."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@functools.lru_cache(maxsize=32)
def _lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16 bits ahead: symbol << 8 | code length (0: no such code). Tables that have been met are kept."""
    out = np.zeros(1 << 16, np.int32)
    for s, (code, n) in _codes(lengths, symbols).items():
        out[code << 16 - n : code + 1 << 16 - n] = s << 8 | n
    return out


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value that size bits stand for."""
    return np.where((size > 0) & (bits < 1 << np.maximum(size, 1) - 1), bits - (1 << size) + 1, bits)


@dataclass
class Header:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantizer
    quant: dict[int, int] = field(default_factory=dict)  # of the DC term
    tables: dict[tuple[int, int], tuple] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    restart: int = 0
    begin: int = 0

    @property
    def sampling(self) -> tuple[int, int]:
        return max(c[1] for c in self.components), max(c[2] for c in self.components)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = (1, 1) if len(self.components) == 1 else self.sampling
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes, at: int = 0) -> Header:
    """Read the markers from SOI to SOS. ValueError for anything but baseline with 8 bits and one scan."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Header(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                out.quant[n] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                lengths = list(body[1:17])
                out.tables[body[0] >> 4, body[0] & 15] = (tuple(lengths), tuple(body[17 : 17 + sum(lengths)]))
                body = body[17 + sum(lengths) :]
        elif marker == 0xC0:
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples are not of 8 bits")
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in {0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)}:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(out.scan) != len(out.components):
                raise ValueError("more than one scan")
            out.begin = at + 2 + size
            return out
        at += 2 + size


def _segments(data: np.ndarray, begin: int) -> tuple[np.ndarray, list[int], int]:
    """A scan's bytes without stuffing, where its restart intervals begin in them, and where the scan ends in the data."""
    ff = np.flatnonzero(data[begin:-1] == 0xFF) + begin
    after = data[ff + 1]
    stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    end = int(stop[0]) if len(stop) else len(data)
    ff, after = ff[ff < end], after[ff < end]
    keep = np.ones(end - begin, bool)
    marks = ff[(after >= 0xD0) & (after <= 0xD7)] - begin
    keep[ff[after == 0] + 1 - begin] = False
    keep[marks] = keep[marks + 1] = False
    upto = np.cumsum(keep)
    return data[begin:end][keep], [0, *upto[marks].tolist()], end


_FAST: dict = {}


def _fast(dc: tuple, ac: tuple) -> np.ndarray:
    """For each 16 bits ahead that hold a whole block without AC terms: (DC difference + 2048) << 8 | bits used; else 0."""
    if (dc, ac) not in _FAST:
        if len(_FAST) > 16:
            _FAST.clear()
        ahead = np.arange(1 << 16)
        found = _lookup(*dc)
        n, size = found & 255, found >> 8
        ok = (n > 0) & (n + size < 16)
        n, size = np.where(ok, n, 0), np.where(ok, size, 0)
        value = _extend(ahead >> (16 - n - size) & (1 << size) - 1, size)
        end = _lookup(*ac)[(ahead << n + size) & 0xFFFF]
        ok &= (end >> 8 == 0) & (end & 255 > 0) & (n + size + (end & 255) <= 16)
        _FAST[dc, ac] = np.where(ok, value + 2048 << 8 | n + size + (end & 255), 0).astype(np.int32)
    return _FAST[dc, ac]


def _lanes(bits: np.ndarray, at: np.ndarray, count: np.ndarray, layout: list[tuple[int, tuple, tuple]], parts: int) -> np.ndarray:
    """Decode restart intervals side by side: the DC terms of each block, shaped (blocks of the longest, lanes).

    bits: at each byte, it and the next two; at: first bit of each lane;
    count: its MCUs; layout: component, DC and AC table of each block of one.
    """
    out = np.zeros((int(count.max()) * len(layout), len(at)), np.int32)
    before = np.zeros((parts, len(at)), np.int32)
    at, last = at.astype(np.int64), len(bits) - 1
    ahead = lambda p: bits[np.minimum(p >> 3, last)] >> (8 - (p & 7)) & 0xFFFF
    even = int(count.min())
    for step in range(int(count.max())):
        live = slice(None) if step < even else np.flatnonzero(count > step)
        for k, (part, dc, ac) in enumerate(layout):
            p = at[live]
            found = _fast(dc, ac)[ahead(p)]
            value, p = (found >> 8) - 2048, p + (found & 255)
            if (rest := np.flatnonzero(found == 0)).size:  # blocks with AC terms or of more bits
                q = p[rest]
                sym = _lookup(*dc)[ahead(q)]
                if (sym & 255 == 0).any():
                    raise ValueError("no such code")
                q, size = q + (sym & 255), sym >> 8
                value[rest] = _extend(ahead(q) >> (16 - size) & (1 << size) - 1, size)
                q = q + size
                table, k_ac, open_ = _lookup(*ac), np.ones(len(q), np.int64), np.arange(len(q))
                while open_.size:
                    sym = table[ahead(q[open_])]
                    if (sym & 255 == 0).any():
                        raise ValueError("no such code")
                    run, size = sym >> 12, sym >> 8 & 15
                    q[open_] += (sym & 255) + size
                    k_ac[open_] += run + 1
                    open_ = open_[~((size == 0) & (run < 15)) & (k_ac[open_] < 64)]
                p[rest] = q
            at[live] = p
            before[part, live] += value
            out[step * len(layout) + k, live] = before[part, live]
    return out


def decode(images: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, luminance thumbnail) of each image: one sample for each 8x8 block, rounded and clipped to a byte."""
    groups: dict[tuple, list] = {}
    for n, data in enumerate(images):
        h = parse(data)
        raw, starts, _ = _segments(np.frombuffer(data, np.uint8), h.begin)
        single = len(h.components) == 1
        where = {c[0]: i for i, c in enumerate(h.components)}
        layout = tuple((where[i], h.tables[0, d], h.tables[1, a]) for i, d, a in h.scan for _ in range(1 if single else h.components[where[i]][1] * h.components[where[i]][2]))
        groups.setdefault(layout, []).append((n, h, raw, starts))
    out: list = [None] * len(images)
    for layout, members in groups.items():
        lanes, counts, chunks, base = [], [], [], 0
        for _, h, raw, starts in members:
            total, step = h.mcus[0] * h.mcus[1], h.restart or h.mcus[0] * h.mcus[1]
            lanes += [8 * (base + s) for s in starts]
            counts += [min(step, total - i * step) for i in range(len(starts))]
            if counts[-1] <= 0 or step * len(starts) < total:
                raise ValueError("restart intervals do not fit the size")
            chunks += [raw, np.full(4, 0xFF, np.uint8)]  # the padding bits are ones
            base += len(raw) + 4
        b = np.concatenate(chunks).astype(np.int32)
        dc = _lanes(b[:-2] << 16 | b[1:-1] << 8 | b[2:], np.array(lanes), np.array(counts), list(layout), len({x[0] for x in layout}))
        luma = [k for k, x in enumerate(layout) if x[0] == layout[0][0]]
        lane = 0
        for n, h, _, starts in members:
            own = dc[:, lane : lane + len(starts)].T.reshape(len(starts), -1, len(layout))[:, :, luma].reshape(-1, len(luma))
            step = h.restart or h.mcus[0] * h.mcus[1]
            keep = np.concatenate([np.arange(c) + i * (len(dc) // len(layout)) for i, c in enumerate(counts[lane : lane + len(starts)])]) if dc.shape[0] // len(layout) != step or counts[lane + len(starts) - 1] != step else slice(None)
            lane += len(starts)
            own = own[keep]
            c = h.components[layout[0][0]]
            bw, bh = (1, 1) if len(h.components) == 1 else c[1:3]
            grid = own.reshape(h.mcus[1], h.mcus[0], bh, bw).transpose(0, 2, 1, 3).reshape(h.mcus[1] * bh, h.mcus[0] * bw)
            mh, mv = h.sampling if len(h.components) > 1 else (c[1], c[2])
            grid = grid[: -(-(-(-h.height * c[2] // mv)) // 8), : -(-(-(-h.width * c[1] // mh)) // 8)]
            out[n] = (h.width, h.height, np.clip((grid * h.quant[c[3]] + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out


def _head(rows: int) -> bytes:
    """Markers of a grey image of WIDTH blocks by so many."""
    seg = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return b"".join(
        [
            b"\xff\xd8",
            seg(0xDB, b"\x00" + b"\x08" + b"\x01" * 63),
            seg(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * WIDTH, 1) + b"\x01\x11\x00"),
            seg(0xC4, b"\x00" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)),
            seg(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS)),
            seg(0xDD, struct.pack(">H", WIDTH)),
            seg(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: the bits of a flat block, left-aligned in 24, and how many."""
    dc, (end, n_end) = _codes(DC_LENGTHS, DC_SYMBOLS), _codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, sizes = [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        value = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << n_end | end
        sizes.append(n + size + n_end)
        bits.append(value << 24 - sizes[-1])
    return np.array(bits, np.int32), np.array(sizes, np.int32)


_BITS, _SIZES = _block_codes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """Store payloads, each of a positive multiple of WIDTH bytes, one or more images each."""
    rows = [len(p) // WIDTH for p in payloads]
    if any(len(p) % WIDTH or not p for p in payloads):
        raise ValueError("a payload is no positive multiple of the width")
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, WIDTH)
    diff = np.diff(samples, axis=1, prepend=np.int16(128)).T + 255  # steps by lanes
    size = _SIZES[diff]
    ends = np.cumsum(size, axis=0, dtype=np.int32)
    n_bytes = (ends[-1] + 7) // 8
    first = np.concatenate([[0], np.cumsum(n_bytes + 2)])  # after each lane, room for its restart marker
    buf = np.zeros(int(first[-1]) + 4, np.uint8)
    for k in range(WIDTH):
        bit = ends[k] - size[k]
        at = first[:-1] + (bit >> 3)
        value = _BITS[diff[k]] >> (bit & 7)
        buf[at] |= (value >> 16).astype(np.uint8)
        buf[at + 1] |= (value >> 8 & 255).astype(np.uint8)
        buf[at + 2] |= (value & 255).astype(np.uint8)
    close = first[1:] - 2
    pad = (8 - (ends[-1] & 7)) & 7
    buf[close - 1] |= ((1 << pad) - 1).astype(np.uint8)
    lane_of = np.concatenate([np.arange(r) % ROWS for r in rows])
    buf[close], buf[close + 1] = 0, 0  # what the last code of a lane spilt over is zero anyway
    stuffed = buf == 0xFF
    buf[close], buf[close + 1] = 0xFF, 0xD0 + (lane_of & 7)
    moved = np.cumsum(stuffed)
    full = np.repeat(buf, 1 + stuffed)
    full[np.flatnonzero(stuffed) + moved[stuffed]] = 0
    place = lambda i: int(first[i] + (moved[first[i] - 1] if first[i] else 0))
    out, lane = [], 0
    for r in rows:
        images = []
        for top in range(0, r, ROWS):
            n = min(ROWS, r - top)
            images.append(_head(n) + full[place(lane + top) : place(lane + top + n) - 2].tobytes() + b"\xff\xd9")
        out.append(b"".join(images))
        lane += r
    return out


def split_images(stored: bytes) -> list[bytes]:
    """The images of one stored form."""
    out, at, data = [], 0, np.frombuffer(stored, np.uint8)
    while at < len(stored):
        end = _segments(data, parse(stored, at).begin)[2] + 2
        out.append(stored[at:end])
        at = end
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each of 8x8 cells of the thumbnail, by means, is darker than the next to its right; 16 hex digits."""
    h, w = thumb.shape
    ys, xs = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 10).astype(int)
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    area = np.maximum(np.diff(ys)[:, None] * np.diff(xs)[None, :], 1)
    s = total[ys[1:]][:, xs[1:]] - total[ys[:-1]][:, xs[1:]] - total[ys[1:]][:, xs[:-1]] + total[ys[:-1]][:, xs[:-1]]
    mean = s * 1000 // area
    return f"{int(''.join('1' if b else '0' for b in (mean[:, 1:] > mean[:, :-1]).ravel()), 2):016x}"


UNIT = 192
FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def store(texts: list[str | None], with_media: bool = True) -> dict[str, list]:
    """The columns of FIELDS for some texts."""
    raw = [(t or "").encode() for t in texts]
    media = encode([b + b" " * (-len(b) % UNIT if b else UNIT) for b in raw]) if raw else []
    parts = [split_images(m) if len(b) > WIDTH * ROWS - UNIT else [m] for b, m in zip(raw, media, strict=True)]
    found = iter(decode([x for p in parts for x in p]))
    out: dict[str, list] = {k.split()[0]: [] for k in FIELDS.split(", ")}
    for b, m, p in zip(raw, media, parts, strict=True):
        images = [next(found) for _ in p]
        thumb = np.concatenate([x[2] for x in images])
        back = thumb.tobytes()
        for k, v in {
            "n_bytes": len(b), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]),
            "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": f"{images[0][0]}x{sum(x[1] for x in images)}:{thumbnail_hash(thumb)}",
            "media": m if with_media else None,
        }.items():
            out[k].append(v)
    return out


def media_columns(df: DataFrame, text: str = "text", keep: list[str] | None = None, with_media: bool = True) -> DataFrame:
    """Store each text as JPEG, read it back, and add the columns of FIELDS (without ``media`` unless asked for).

    A null text counts as empty; an empty one is stored as 192 spaces. Rows
    and other columns stay; columns of the same names are replaced.
    """

    def make():
        def work(texts):
            out: dict[str, list] = {}
            group, size = [], 0
            for t in [*texts, None]:  # bounded groups; the last None only ends the last
                group.append(t)
                size += len(t or "")
                if size > 1 << 20 or len(group) > 256:
                    _extend_all(out, store(group, with_media))
                    group, size = [], 0
            _extend_all(out, store(group, with_media))
            return {k: v[: len(texts)] for k, v in out.items()}

        return work

    return annotate(df, text, FIELDS if with_media else FIELDS.rpartition(", ")[0], make, keep)


def _extend_all(out: dict[str, list], more: dict[str, list]) -> None:
    for k, v in more.items():
        out.setdefault(k, []).extend(v)


def thumbnails(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Add width, height and thumbnail hash of images in a binary column of baseline JPEGs; null for null or what is none."""
    from pyspark.sql import functions as F

    def make():
        import base64

        def one(x):
            if not x:
                return None
            try:
                return decode([base64.b64decode(x)])[0]
            except (ValueError, KeyError, IndexError, struct.error):
                return None

        def work(rows):
            found = [one(x) for x in rows]
            return {"width": [f and f[0] for f in found], "height": [f and f[1] for f in found], "thumb_hash": [f and thumbnail_hash(f[2]) for f in found]}

        return work

    return annotate(df, F.base64(F.col(f"`{media}`")), "width long, height long, thumb_hash string", make, keep)
