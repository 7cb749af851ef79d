"""GIF89a in bytes: LZW code streams, palettes, disposal, transparency, interlace; frames with their times.

The decoder takes any GIF. Codes between two clears have widths that depend on their number alone, so they are cut
from the bit stream as arrays; strings are then built code by code.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

TABLE = 4096


def _widths(bits: int, n: int) -> np.ndarray:
    """Widths of the first n codes after a clear: one more bit once the next free entry needs it, 12 at most."""
    free = np.minimum((1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0), TABLE)
    out = np.full(n, bits + 1)
    for w in range(bits + 1, 12):
        out[free >= (1 << w)] = w + 1
    return out


def lzw_encode(data: bytes, bits: int) -> bytes:
    """Codes for samples below 2**bits, a clear first and whenever the table is full."""
    clear = 1 << bits
    sections = []
    known: dict[int, int] = {}  # shifted code of a string | next sample: shifted code of both
    get, free, full, out = known.get, clear + 2 << 8, TABLE << 8, [clear << 8]
    add = out.append
    it = iter(data)
    p = next(it, None)
    if p is not None:
        p <<= 8
        for b in it:
            c = get(p | b)
            if c:
                p = c
                continue
            add(p)
            if free < full:
                known[p | b] = free
                free += 256
            else:
                add(clear << 8)
                sections.append(out)
                known.clear()
                free, out = clear + 2 << 8, []
                add = out.append
            p = b << 8
        add(p)
    out.append(clear + 1 << 8)
    sections.append(out)
    all_widths = []
    for i, codes in enumerate(sections):
        n = len(codes)
        if i == 0:  # the very first code is the clear itself, of the least width
            w = np.concatenate([[bits + 1], _widths(bits, n - 1)])
        else:
            w = _widths(bits, n)
        all_widths.append(w)
    width = np.concatenate(all_widths)
    value = np.concatenate([np.asarray(s, np.int64) for s in sections]) >> 8
    at = np.cumsum(width) - width
    total = int(width.sum())
    flat = np.zeros((total + 7) // 8 * 8, np.uint8)
    for b in range(12):
        has = width > b
        flat[at[has] + b] = (value[has] >> b) & 1
    return np.packbits(flat, bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int, n: int) -> bytes:
    """The first n samples; short streams are filled with 0, as viewers do."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    total, at = len(data) * 8, 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    parts, size = [], 0
    schedule = _widths(bits, TABLE * 2)
    starts = np.cumsum(schedule) - schedule
    while size < n and at < total:
        fit = int(np.searchsorted(starts + schedule, total - at, "right"))
        if not fit:
            break
        k = min(fit, TABLE - clear)  # as many codes as fill the table
        while True:
            pos = at + starts[:k]
            codes = (window[pos >> 3] >> (pos & 7).astype(np.uint32)) & ((1 << schedule[:k]) - 1).astype(np.uint32)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or k == fit:
                break
            if k == len(schedule):
                schedule = np.concatenate([schedule, np.full(len(schedule), 12)])
                starts = np.cumsum(schedule) - schedule
            fit = int(np.searchsorted(starts + schedule, total - at, "right"))
            k = min(fit, k * 2, len(schedule))
        stop = int(stops[0]) if len(stops) else k
        run = codes[:stop].tolist()
        if run:
            table = roots[:]
            last = table[run[0]] if run[0] < clear else b""
            mine = [last]
            add, put = mine.append, table.append
            growing = TABLE - len(table) + 1  # codes that each make an entry
            for c in run[1:growing]:
                try:
                    s = table[c]
                    put(last + s[:1])
                except IndexError:
                    s = last + last[:1]
                    put(s)
                add(s)
                last = s
            mine += [table[c] for c in run[growing:]]
            parts += mine
            size += sum(map(len, mine))
        if stop >= k and not len(stops):
            break
        at += int(starts[stop] + schedule[stop])
        if len(stops) and codes[stop] == end:
            break
    return b"".join(parts)[:n].ljust(n, b"\0")


@dataclass
class Image:
    """A stored picture of a GIF: its place, its samples (palette numbers), and how it is shown."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int = 0
    palette: np.ndarray | None = None
    images: list[Image] = field(default_factory=list)

    def frames(self):
        """The canvas as shown, one RGBA array a picture, with its start time and duration in hundredths of a second."""
        canvas = np.zeros((self.height, self.width, 4), np.uint8)
        at = 0
        for im in self.images:
            before = canvas.copy() if im.disposal == 3 else None
            h, w = im.samples.shape
            y, x = slice(im.top, min(im.top + h, self.height)), slice(im.left, min(im.left + w, self.width))
            samples = im.samples[: y.stop - y.start, : x.stop - x.start] if y.stop > y.start and x.stop > x.start else im.samples[:0, :0]
            if samples.size:
                colours = np.zeros((256, 4), np.uint8)
                colours[: len(im.palette), :3] = im.palette
                colours[: len(im.palette), 3] = 255
                shown = colours[samples]
                if im.transparent is None:
                    canvas[y, x] = shown
                else:
                    canvas[y, x] = np.where((samples == im.transparent)[..., None], canvas[y, x], shown)
            yield canvas.copy(), at, im.delay
            at += im.delay
            if im.disposal == 2 and samples.size:
                canvas[y, x] = 0
            elif im.disposal == 3:
                canvas = before


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and (n := data[at]):
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def decode(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, out = 13, Gif(width, height, background)

    def palette(flags: int, at: int):
        n = 3 * (2 << (flags & 7))
        return np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3), at + n

    if flags & 0x80:
        out.palette, at = palette(flags, at)
    delay, disposal, transparent = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            body, nxt = _blocks(data, at + 2)
            if data[at + 1 : at + 2] == b"\xf9" and len(body) >= 4:
                delay = body[1] | body[2] << 8
                disposal = body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
            at = nxt
        elif kind == 0x2C and at + 10 <= len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = out.palette
            if flags & 0x80:
                own, at = palette(flags, at)
            if own is None:
                own = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
            bits = data[at]
            body, at = _blocks(data, at + 1)
            samples = np.frombuffer(lzw_decode(body, bits, w * h), np.uint8).reshape(h, w)
            if flags & 0x40:  # interlaced: rows 0, 8, …; 4, 12, …; 2, 6, …; 1, 3, …
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                samples = samples[np.argsort(order)]
            out.images.append(Image(left, top, samples, own, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            break
    return out


def encode(gif: Gif) -> bytes:
    """A GIF89a with an 8-bit palette for all pictures and, where a picture's differs, one of its own."""

    def full(p: np.ndarray) -> bytes:
        return p.astype(np.uint8).tobytes().ljust(768, b"\0")

    common = gif.palette if gif.palette is not None else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, 0xF7, gif.background, 0), full(common)]
    for im in gif.images:
        h, w = im.samples.shape
        clear = im.transparent is not None
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, im.disposal << 2 | clear, im.delay, im.transparent or 0, 0))
        own = im.palette is not common and full(im.palette) != full(common)
        out.append(struct.pack("<BHHHHB", 0x2C, im.left, im.top, w, h, 0x87 if own else 0))
        if own:
            out.append(full(im.palette))
        body = lzw_encode(np.ascontiguousarray(im.samples, np.uint8).tobytes(), 8)
        out.append(b"\x08" + b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\0")
    return b"".join(out) + b";"
