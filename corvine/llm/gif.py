"""GIF87a/89a: a block parser with LZW decoding, a compositor, and an encoder for indexed frames. Files are read frame by frame."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: 256 colours; red alone tells the index.
COLOURS = bytes(v & 255 for i in range(256) for v in (i, 7 * i, 29 * i))
#: Pixels of a canvas or frame at most; larger ones are an error. A canvas takes four bytes a pixel.
PIXELS = 1 << 26


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray | None
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None
    canvas: np.ndarray | None = field(default=None, repr=False)


def lzw_encode(data: bytes, code_bits: int = 8) -> bytes:
    """Variable-width LZW codes, least significant bit first, with a leading clear and an end code."""
    clear = 1 << code_bits
    codes, widths, runs = [clear], [], []
    width, following, known = code_bits + 1, clear + 2, {}
    full = 1 << width
    mark = 0
    if data:
        get, push = known.get, codes.append
        current = data[0]
        for b in memoryview(data)[1:]:
            key = current << 8 | b
            code = get(key)
            if code is not None:
                current = code
                continue
            push(current)
            if following == 4096:
                runs.append((len(codes) - mark, width))
                mark = len(codes)
                push(clear)
                runs.append((1, width))
                mark += 1
                known.clear()
                width, following = code_bits + 1, clear + 2
                full = 1 << width
            else:
                known[key] = following
                following += 1
                if following > full and width < 12:
                    runs.append((len(codes) - mark, width))
                    mark = len(codes)
                    width += 1
                    full <<= 1
            current = b
        push(current)
        # the reader has made one entry more than the writer by now, which may widen its codes
        if following + 1 > full and width < 12:
            runs.append((len(codes) - mark, width))
            mark = len(codes)
            width += 1
    push_end = clear + 1
    codes.append(push_end)
    runs.append((len(codes) - mark, width))
    widths = np.repeat([w for _, w in runs], [n for n, _ in runs])
    return pack(np.array(codes, dtype=np.int64), widths)


def pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of their widths one after the other. Their bits do not overlap, so bytes are sums."""
    ends = np.cumsum(widths)
    at = ends - widths
    first, bits = at >> 3, codes << (at & 7)
    size = int(ends[-1] + 7) // 8
    out = sum(np.bincount(first + k, weights=bits >> 8 * k & 255, minlength=size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, code_bits: int, pixels: int) -> bytes:
    """The first ``pixels`` indices of a code stream; short or broken streams raise ValueError."""
    clear, end = 1 << code_bits, (1 << code_bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    total = len(stream) * 8
    out, have, bit = [], 0, 0
    put = out.append
    while have < pixels:
        # from one clear to the next, the width of each code follows from its place alone
        table, prev, width, done = base.copy(), None, code_bits + 1, False
        add = table.append
        while not done:
            full = width == 12 and len(table) >= 4096
            room = 4096 if full else max(1, (1 << width) - len(table) + (prev is None))
            n = min(room, (total - bit) // width)
            if n <= 0:
                raise ValueError("the code stream ends early")
            at = bit + width * np.arange(n, dtype=np.int64)
            codes = (words[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << width) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops):
                done, n = True, int(stops[0])
                last = int(codes[n]) == end
                bit += width
                codes = codes[:n]
            bit += width * n
            mark = len(out)
            todo = iter(codes.tolist())
            try:
                if prev is None:
                    for c in todo:
                        if c > end:
                            raise ValueError("a code without an entry")
                        put(prev := table[c])
                        break
                if full:
                    for c in todo:
                        put(prev := table[c])
                else:
                    for c in todo:
                        if c == len(table):
                            word = prev + prev[:1]
                            add(word)
                        else:
                            word = table[c]
                            add(prev + word[:1])
                        put(word)
                        prev = word
            except IndexError:
                raise ValueError("a code without an entry") from None
            have += sum(map(len, out[mark:]))
            if have >= pixels:
                done = True
            elif done and last:
                raise ValueError("the image ends early")
            if len(table) >= 1 << width and width < 12:
                width += 1
    return b"".join(out)[:pixels]


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def checked(width: int, height: int, data: bytes) -> tuple[int, int]:
    """The size of a canvas or frame, if it may be taken into memory: PIXELS at most, and no more than the file could paint (a code of nine
    bits or more stands for 4096 pixels at most), but for small ones."""
    if width * height > min(PIXELS, max(1 << 16, len(data) * 8 // 9 * 4096)):
        raise ValueError(f"{width} x {height} pixels are too many")
    return height, width


def decode(data: bytes) -> Iterator[Frame]:
    """The frames with their own pixels, each with the composed canvas (RGBA) until the next is asked for; the canvas is one
    array that all frames are painted on. Broken files raise ValueError, IndexError or struct.error where they break."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    canvas = np.zeros((*checked(width, height, data), 4), np.uint8)
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    control = (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None)
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            shape = checked(w, h, data)
            at += 10
            own = palette
            if flags & 0x80:
                n = 3 << (flags & 7) + 1
                own = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
                at += n
            bits = data[at]
            if not 1 <= bits <= 11:
                raise ValueError(f"codes of {bits} bits")
            stream, at = blocks(data, at + 1)
            pixels = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8).reshape(shape)
            if flags & 0x40:
                rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(pixels)
                straight[rows] = pixels
                pixels = straight
            frame = Frame(left, top, w, h, pixels, own, control[1], control[0], control[2], canvas)
            region, before = painted(frame)
            yield frame
            if frame.disposal in (2, 3):
                canvas[region] = before
            control = (0, 0, None)
        else:
            raise ValueError(f"unknown block {data[at]:#x}")
    if at >= len(data):
        raise ValueError("the file ends early")


def size(data: bytes) -> tuple[int, int]:
    return struct.unpack_from("<HH", data, 6)


def painted(f: Frame) -> tuple:
    """Paint a frame on its canvas by palette and transparency; its region, and what its disposal puts there afterwards."""
    region = (slice(f.top, f.top + f.height), slice(f.left, f.left + f.width))
    under = f.canvas[region]
    own = f.indices[: under.shape[0], : under.shape[1]]
    before = under.copy() if f.disposal == 3 else 0
    colours = np.zeros((256, 4), np.uint8)
    if f.palette is not None:
        colours[: len(f.palette), :3] = f.palette
    colours[:, 3] = 255
    if f.transparent is None:
        under[:] = colours[own]
    else:
        shown = own != f.transparent
        under[shown] = colours[own[shown]]
    return region, before


def encode(frames: list[Frame], width: int, height: int, palette: bytes = COLOURS) -> bytes:
    """GIF89a with a global palette of 256 colours."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent is not None), f.delay_cs, f.transparent or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, f.width, f.height, 0))
        stream = lzw_encode(f.indices.tobytes())
        out.append(b"\x08" + b"".join(bytes([len(s := stream[i : i + 255])]) + s for i in range(0, len(stream), 255)) + b"\0")
    return b"".join([*out, b";"])
