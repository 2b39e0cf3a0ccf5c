"""Motion-JPEG video in AVI files: write, index, decode, and cut into shots.

Frames are single-component 8-bit lossless JPEG (process 14, predictor 1): each is an intra
frame, and each sample comes back exactly.  The Huffman table gives category ``s`` a code of
``9 - s`` bits, so that code and extra bits together always take nine bits a sample; numpy then
decodes all frames of a file at once.  Files with other tables decode sample by sample, and usual Motion-JPEG
(baseline frames, ``jpeg``) by its luma.

Defined cases: null and empty text is a payload of 64 zero bytes; null ids stay; equal texts give
equal rows; a file that isn't AVI, or has no frames, yields no clips; a file with a frame that is damaged or of
another process (progressive, point transforms, lossless with restarts) yields one row without clip, and its error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import as_bytes, map_rows, slices, text_only

WIDTH, HEIGHT, FPS = 64, 16, 25
UNIT = 64
BINS = 16
#: A cut needs a histogram difference (0..2) above FLOOR and above the mean of its neighbours
#: plus SPREAD deviations; WINDOW is how many differences on each side count as neighbours.
FLOOR, SPREAD, WINDOW = 0.25, 2.0, 6


def _tables() -> tuple[np.ndarray, np.ndarray]:
    diffs = np.arange(-255, 256)
    size = np.zeros(511, np.int64)
    for s in range(8):
        size[np.abs(diffs) >= 1 << s] = s + 1
    prefix = np.array([0b111111110 & (1 << 9 - s) - 1 for s in range(9)])  # 8-s ones, then a zero
    code = (prefix[size] << size) | np.where(diffs > 0, diffs, diffs + (1 << size) - 1)
    back = np.zeros(512, np.int16)
    back[code] = diffs
    return code.astype(np.uint16), back


CODE, BACK = _tables()
#: Code counts for lengths 1 to 16, then the categories in order of their code length.
HUFFMAN = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def _jpeg_head(height: int, width: int) -> bytes:
    seg = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return b"\xff\xd8" + seg(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + seg(0xC4, b"\0" + HUFFMAN) + seg(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose luma samples, frame after frame, are the payload (a multiple of 64)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int16)
    diff = np.empty_like(rows)
    diff[:, 1:] = rows[:, 1:] - rows[:, :-1]
    diff[1:, 0] = rows[1:, 0] - rows[:-1, 0]
    diff[::HEIGHT, 0] = rows[::HEIGHT, 0] - 128
    c = CODE[diff.reshape(-1, 8) + 255]
    packed = np.empty((len(c), 9), np.uint8)
    packed[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        packed[:, k] = ((c[:, k - 1] & ((1 << k) - 1)) << (8 - k)) | (c[:, k] >> (k + 1))
    packed[:, 8] = c[:, 7] & 0xFF
    coded, step = packed.tobytes(), WIDTH * HEIGHT // 8 * 9
    full, last = _jpeg_head(HEIGHT, WIDTH), _jpeg_head((len(rows) - 1) % HEIGHT + 1, WIDTH)
    movi, index, at = [], [], 4
    for start in range(0, len(coded), step):
        head = full if start + step <= len(coded) else last
        data = head + coded[start : start + step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(data)))
        data = struct.pack("<4sI", b"00dc", len(data)) + data + b"\0" * (len(data) & 1)
        movi.append(data)
        at += len(data)
    n = len(index)
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl) + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def read_index(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds a frame, and offset and length of each video frame.

    Frames come from the ``idx1`` index; its offsets count from the ``movi`` list or from the
    start of the file.  Without a usable index the ``movi`` lists themselves are walked, those of
    later RIFF segments included.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return 0.0, []
    per_frame, movi, index, at = 1 / FPS, [], b"", 0
    stack = [(0, len(data))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            body, stop = at + 8, min(at + 8 + size, end)
            if name in (b"RIFF", b"LIST"):
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi.append((body, stop))
                else:
                    stack.append((stop + (size & 1), end))
                    at, end = body + 4, stop
                    continue
            elif name == b"avih" and stop - body >= 4:
                per_frame = (struct.unpack_from("<I", data, body)[0] or 1_000_000 // FPS) / 1e6
            elif name == b"idx1":
                index = data[body:stop]
            at = stop + (size & 1)
    is_video = lambda name: name[2:4] in (b"dc", b"db")
    if movi and len(movi) == 1 and index:
        base = movi[0][0]
        entries = [e for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if is_video(e[0])]
        for shift in (base, 0):
            if entries and all(data[o + shift : o + shift + 4] == n and o + shift + 8 + s <= len(data) for n, _, o, s in entries):
                return per_frame, [(o + shift + 8, s) for _, _, o, s in entries]
    found = []
    for start, stop in movi:
        at = start + 4
        while at + 8 <= stop:
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":
                at += 12
                continue
            if is_video(name) and at + 8 + size <= stop:
                found.append((at + 8, size))
            at += 8 + size + (size & 1)
    return per_frame, found


def _head(frame: bytes) -> tuple[int, int, int, bytes, int, int] | None:
    """Height, width, predictor, Huffman table, restart interval and where the coded data begin; None for frames that aren't lossless."""
    at, height, width, table, restart = 2, 0, 0, b"", 0
    while at + 4 <= len(frame):
        mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if mark == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only 8-bit single-component frames are read")
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return None
        elif mark == 0xC4:
            table = body[1:]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            if body[-1] & 15:
                raise ValueError("point transforms are not read")
            return height, width, body[-3], table, restart, at + 2 + size
        at += 2 + size
    raise ValueError("no scan in the frame")


def _slow(coded: bytes, height: int, width: int, predictor: int, table: bytes) -> np.ndarray:
    """Any Huffman table and predictors 1 to 7, sample by sample."""
    codes, code, k = {}, 0, 16
    for length, n in enumerate(table[:16], 1):
        for _ in range(n):
            codes[length, code] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits, at = int.from_bytes(coded, "big"), len(coded) * 8
    out = [[0] * width for _ in range(height)]
    for y in range(height):
        for x in range(width):
            code = length = 0
            while (length, code) not in codes:
                at -= 1
                code, length = code << 1 | bits >> at & 1, length + 1
                if length > 16 or at < 0:
                    raise ValueError("bad Huffman code")
            s = codes[length, code]
            at -= s
            extra = bits >> at & ((1 << s) - 1)
            d = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
            a, b, c = out[y][x - 1] if x else 0, out[y - 1][x] if y else 0, out[y - 1][x - 1] if x and y else 0
            if not y:
                p = a if x else 128
            elif not x:
                p = b
            else:
                p = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
            out[y][x] = p + d & 0xFF
    return np.array(out, np.uint8)


_MARKS = re.compile(rb"\xff[\xd0-\xd7]")


def decode_frames(data: bytes, frames: list[tuple[int, int]]) -> list[np.ndarray]:
    """The samples of each frame, of its luma if it has colours; ValueError if one can't be read."""
    try:
        return _decode(data, frames)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"damaged JPEG frame: {e!r}") from e


#: Bytes of a head as written here; frames that begin with the same ones have the same head.
HEAD = len(_jpeg_head(HEIGHT, WIDTH))


def _decode(data: bytes, frames: list[tuple[int, int]]) -> list[np.ndarray]:
    heads: dict[bytes, tuple] = {}
    fast, out = [], [None] * len(frames)
    for k, (at, size) in enumerate(frames):
        frame = data[at : at + size]
        known = frame[:HEAD]
        head = heads.get(known)
        if head is None:
            head = _head(frame)
            if head is None:
                out[k] = jpeg.luma(frame)
                continue
            if head[5] <= HEAD:
                heads.clear() if len(heads) > 64 else None
                heads[known] = head
        height, width, predictor, table, restart, start = head
        end = frame.rfind(b"\xff\xd9")
        coded = frame[start : end if end >= 0 else None]
        if restart:
            raise ValueError("lossless frames with restart intervals are not read")
        coded = coded.replace(b"\xff\x00", b"\xff")
        if table == HUFFMAN and predictor == 1 and width % 8 == 0 and len(coded) * 8 == height * width * 9:
            fast.append((k, height, width, coded))
        else:
            out[k] = _slow(coded, height, width, predictor, table)
    for width in {w for _, _, w, _ in fast}:
        same = [x for x in fast if x[2] == width]
        b = np.frombuffer(b"".join(x[3] for x in same), np.uint8).reshape(-1, 9).astype(np.uint16)
        codes = np.empty((len(b), 8), np.uint16)
        for j in range(8):
            codes[:, j] = (b[:, j] << (j + 1) | b[:, j + 1] >> (7 - j)) & 0x1FF
        diff = BACK[codes].reshape(-1, width)
        starts = np.cumsum([0] + [x[1] for x in same])
        first = np.cumsum(diff[:, 0], dtype=np.int64)
        before = np.concatenate([[0], first[starts[1:-1] - 1]])
        diff[:, 0] = first - np.repeat(before, np.diff(starts)) + 128
        samples = np.cumsum(diff, axis=1, dtype=np.int16).astype(np.uint8)
        for x, a, z in zip(same, starts, starts[1:]):
            out[x[0]] = samples[a:z]
    return out


def shot_starts(frames: list[np.ndarray]) -> np.ndarray:
    """First frame of each shot: where the grey histograms of neighbours differ much more than nearby."""
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    sizes = np.array([f.size for f in frames])
    bins = (np.concatenate([f.ravel() for f in frames]) >> 4).astype(np.int64) + np.repeat(np.arange(n) * BINS, sizes)
    hist = np.bincount(bins, minlength=n * BINS).reshape(n, BINS) / sizes[:, None]
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    sums = np.concatenate([[0], np.cumsum(d)])
    squares = np.concatenate([[0], np.cumsum(d * d)])
    lo, hi = np.maximum(np.arange(n - 1) - WINDOW, 0), np.minimum(np.arange(n - 1) + WINDOW + 1, n - 1)
    around = hi - lo - 1
    safe = np.maximum(around, 1)
    mean = (sums[hi] - sums[lo] - d) / safe
    spread = np.sqrt(np.maximum((squares[hi] - squares[lo] - d * d) / safe - mean * mean, 0))
    limit = np.where(around > 0, np.maximum(FLOOR, mean + SPREAD * spread), FLOOR)
    return np.concatenate([[0], np.flatnonzero(d > limit) + 1])


def clips(data: bytes) -> Iterator[dict]:
    """Timed shots of one AVI file."""
    per_frame, found = read_index(data)
    starts = shot_starts(decode_frames(data, found)).tolist()
    for k, (a, z) in enumerate(zip(starts, starts[1:] + [len(found)])):
        yield {"clip": k, "first_frame": a, "n_frames": z - a, "start_s": a * per_frame, "end_s": z * per_frame}


def clip_rows(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each shot of each file: the key and clip, first_frame, n_frames, start_s, end_s, error.

    error is null but for files that can't be read, which have one row and nothing else in it.
    """
    key_type = dict(df.dtypes)[key]
    names = ("clip", "first_frame", "n_frames", "start_s", "end_s", "error")

    def run(batches):
        for batch in slices(batches):
            keys, rows = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(clips(data or b""))
                except ValueError as e:
                    found = [{"error": str(e)}]
                keys += [k] * len(found)
                rows += found
            if rows:
                columns = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.string()])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *columns], [key, *names])

    return df.select(key, media).mapInArrow(run, f"`{key}` {key_type}, clip long, first_frame long, n_frames long, start_s double, end_s double, error string")


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (UNIT if not text else 0))


def encode(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``: each text stored as an AVI file."""
    return map_rows(text_only(docs), lambda b: {"doc_id": b.column(0), "media": [write_avi(payload_of(t)) for t in as_bytes(b.column(1))]}, "doc_id long, media binary")


_FIELDS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_clips")


def _digest_one(text: bytes) -> tuple:
    media = write_avi(payload_of(text))
    per_frame, found = read_index(media)
    frames = decode_frames(media, found)
    back = b"".join(f.tobytes() for f in frames)
    starts = shot_starts(frames)
    feature = f"fps={1 / per_frame:g};frames={len(frames)};cuts=" + ",".join(map(str, starts.tolist()))
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), len(starts)


def digest(docs: DataFrame) -> DataFrame:
    """Store each text as video, read it back, and describe payload, file and shots."""

    def make(batch):
        rows = [_digest_one(t) for t in as_bytes(batch.column(1))]
        return {"doc_id": batch.column(0)} | dict(zip(_FIELDS, map(list, zip(*rows))))

    return map_rows(text_only(docs), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_clips long")
