"""AVI motion-JPEG columns: write and parse RIFF files, decode intra frames, detect shots, yield timed clips.

Frames are grey. Frames that this module writes use the lossless JPEG process (start of frame 3, first
predictor, 8-bit samples), so any payload survives; the reader takes such frames with any Huffman tables of
up to 16 bits and any of the seven predictors, and baseline DCT frames (start of frame 0) of one component.
Frames of one batch are decoded together, one sample of every frame at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdantflow.llm.shared import slices

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
BINS = 16
# code lengths of the difference categories 0 to 8: with its bits of value each difference takes two bytes, so that the
# codec of a table of files finds what repeats in a frame and between frames; closer codes would hide it
_LENGTHS = tuple(16 - s for s in range(9))


def _canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length) in the order of the JPEG standard, for (length, symbol) pairs in table order."""
    out, code, last = {}, 0, 0
    for length, symbol in lengths:
        code <<= length - last
        out[symbol] = (code, length)
        code, last = code + 1, length
    return out


@lru_cache(maxsize=1)
def _writer() -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and bits of each difference + 255, and what stands before the scan of a frame."""
    order = sorted((n, s) for s, n in enumerate(_LENGTHS))
    table = _canonical(order)
    value, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = table[s]
        value[d + 255], bits[d + 255] = (code << s) | (d if d >= 0 else d + (1 << s) - 1), n + s
    number = bytes(sum(n == k for n, _ in order) for k in range(1, 17))
    symbols = bytes(s for _, s in order)
    head = b"\xff\xd8\xff\xc4" + struct.pack(">HB", 3 + 16 + len(symbols), 0) + number + symbols
    head += b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    head += b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
    return value, bits, head


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A lossless JPEG for each of the (frames, 24, 24) 8-bit samples."""
    value, bits, head = _writer()
    s = samples.astype(np.int16)
    d = np.empty_like(s)
    d[:, 0, 0] = s[:, 0, 0] - 128
    d[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    d[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    d = d.reshape(len(s), FRAME) + 255
    n = bits[d]
    ends = np.cumsum(n, 1)
    size = (ends[:, -1] + 7) // 8
    begin = np.concatenate(([0], np.cumsum(size)))
    at = (ends - n + 8 * begin[:-1, None]).ravel()
    word = value[d].ravel() << (24 - (at & 7) - n.ravel())
    at >>= 3
    total = int(begin[-1]) + 2
    raw = np.zeros(total)
    for k in range(3):
        raw += np.bincount(at + k, (word >> (16 - 8 * k)) & 255, total)
    raw = raw.astype(np.uint8)[: begin[-1]]
    spare = (8 * size - ends[:, -1]).astype(np.uint8)
    raw[begin[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)  # filled up with ones
    full = raw == 255
    place = np.arange(len(raw)) + np.cumsum(full) - full
    stuffed = np.zeros(len(raw) + int(full.sum()), np.uint8)
    stuffed[place] = raw
    cut = np.append(place[begin[:-1]], len(stuffed)).tolist()
    data = stuffed.tobytes()
    return [head + data[a:b] + b"\xff\xd9" for a, b in zip(cut, cut[1:])]


def riff(frames: list[bytes], width: int = SIDE, height: int = SIDE, rate: int = RATE) -> bytes:
    """An AVI file of one motion-JPEG stream with its index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)

    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    parts, index, at = [], [], 4
    for frame in frames:
        parts.append(chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(parts[-1])
    body = b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index))
    if len(body) >= 1 << 32:
        raise ValueError("an AVI file of one RIFF chunk holds less than 4 GiB")
    return chunk(b"RIFF", body)


def parse_riff(data: bytes) -> tuple[list[tuple[int, int]], float]:
    """Where each video frame lies (begin, end), in order of the index, and frames a second.

    Without an index the chunks of the movi list are walked. ValueError if it isn't an AVI file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, rate = None, None, 0.0

    def walk(at: int, end: int) -> None:
        nonlocal movi, index, rate
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, stop)
                else:
                    walk(body + 4, stop)
            elif name == b"strh" and data[body : body + 4] == b"vids" and not rate:
                scale, ticks = struct.unpack_from("<II", data, body + 20)
                rate = ticks / scale if scale else 0.0
            elif name == b"idx1":
                index = (body, stop)
            at = stop + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        raise ValueError("an AVI file without a movi list")
    found = []
    if index:
        entries = np.frombuffer(data, "<u4", (index[1] - index[0]) // 16 * 4, index[0]).reshape(-1, 4)
        names = entries[:, 0].astype("<u4").view("S4")
        # offsets count from the movi list, in some files from the start
        base = movi[0] if len(entries) and data[movi[0] + int(entries[0, 2]) :][:4] == names[0] else 0
        found = [(base + int(o) + 8, base + int(o) + 8 + int(n)) for name, o, n in zip(names.tolist(), entries[:, 2], entries[:, 3]) if name[2:] in (b"dc", b"db")]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                found.append((at + 8, min(at + 8 + size, movi[1])))
            at += 8 + size + (size & 1)
    return found, rate


def _segments(jpeg: bytes) -> tuple[bytes, int]:
    """The marker segments of a frame up to its scan, and where the scan begins."""
    at = 2
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            return jpeg[2:at], at


@lru_cache(maxsize=64)
def _read_head(head: bytes) -> dict:
    """Huffman and quantisation tables, size, process and predictor of the segments before a scan."""
    out: dict = {"huffman": {}, "quant": {}}
    at = 0
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                kind, number = body[0], body[1:17]
                symbols = body[17 : 17 + sum(number)]
                pairs = [n for k, count in enumerate(number, 1) for n in [k] * count]
                out["huffman"][kind] = _canonical(list(zip(pairs, symbols)))
                body = body[17 + len(symbols) :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC3):
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit frames of one component are read")
            out |= {"process": marker, "height": height, "width": width, "table": body[8]}
        elif marker == 0xDD and body != b"\0\0":
            raise ValueError("restart intervals aren't read")
        elif marker == 0xDA:
            out |= {"tables": body[2], "predictor": body[-3]}
    if "process" not in out:
        raise ValueError("only baseline and lossless frames are read")
    return out


def _windows(table: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16-bit window."""
    symbol, length = np.zeros(1 << 16, np.int64), np.full(1 << 16, 17, np.int64)
    for s, (code, n) in table.items():
        a = code << (16 - n)
        symbol[a : a + (1 << (16 - n))], length[a : a + (1 << (16 - n))] = s, n
    return symbol, length


@lru_cache(maxsize=16)
def _differences(head: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """For every window of so many bits the difference and all its bits, if codes and values fit into 16."""
    table = _read_head(head)["huffman"][_read_head(head)["tables"] >> 4]
    most = max(n + s for s, (_, n) in table.items())
    if most > 16:
        raise ValueError("differences of more than 16 bits aren't read")
    value, length = np.zeros(1 << most, np.int32), np.full(1 << most, most, np.int64)
    for s, (code, n) in table.items():
        for v in range(1 << s):
            d = v if s == 0 or v >> (s - 1) else v - (1 << s) + 1
            a = ((code << s) | v) << (most - n - s)
            value[a : a + (1 << (most - n - s))], length[a : a + (1 << (most - n - s))] = d, n + s
    return value, length, most


def _unstuffed(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All scans in one array without the zero bytes after 255 and the end markers, and where each begins."""
    raw = np.frombuffer(b"".join(scans) + b"\xff\xd9\0\0\0", np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[:-1] == 255) & (raw[1:] == 0))
    begin = np.concatenate(([0], np.cumsum([len(s) for s in scans])[:-1]))
    keep[begin] = True
    return raw[keep], (np.cumsum(keep) - 1)[begin]


def _decode_lossless(head: bytes, scans: list[bytes]) -> np.ndarray:
    info = _read_head(head)
    value, length, most = _differences(head)
    raw, at = _unstuffed(scans)
    wide = (raw[:-3].astype(np.int64) << 24) | (raw[1:-2].astype(np.int64) << 16) | (raw[2:-1].astype(np.int64) << 8) | raw[3:]
    at, last = at * 8, 8 * (len(wide) - 1)
    d = np.empty((info["height"] * info["width"], len(scans)), np.int32)
    mask, shift = (1 << most) - 1, 32 - most
    for k in range(len(d)):
        np.minimum(at, last, out=at)
        window = (wide[at >> 3] >> (shift - (at & 7))) & mask
        d[k] = value[window]
        at += length[window]
    d = d.T.reshape(len(scans), info["height"], info["width"])
    predictor = info["predictor"]
    if predictor == 1:
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
        return (np.cumsum(d, 2) & 255).astype(np.uint8)
    s = np.zeros_like(d)
    for y in range(d.shape[1]):
        for x in range(d.shape[2]):
            a, b, c = s[:, y, x - 1] if x else 0, s[:, y - 1, x] if y else 0, s[:, y - 1, x - 1] if x and y else 0
            if not x and not y:
                p = 128
            elif not y:
                p = a
            elif not x:
                p = b
            else:
                p = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            s[:, y, x] = (d[:, y, x] + p) & 0xFFFF
    return (s & 255).astype(np.uint8)


@lru_cache(maxsize=1)
def _zigzag() -> tuple[np.ndarray, np.ndarray]:
    """Place in its block of each coefficient in scan order, and the cosine basis."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.array(order), np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)


def _decode_baseline(head: bytes, scans: list[bytes]) -> np.ndarray:
    info = _read_head(head)
    (dc, dc_n), (ac, ac_n) = (_windows(info["huffman"][k]) for k in (info["tables"] >> 4, 0x10 | (info["tables"] & 15)))
    order, basis = _zigzag()
    down, across = -(-info["height"] // 8), -(-info["width"] // 8)
    out = np.empty((len(scans), info["height"], info["width"]), np.uint8)
    for f, scan in enumerate(scans):
        raw, _ = _unstuffed([scan])
        bits, at, before = int.from_bytes(raw.tobytes() + bytes(8), "big"), 0, 0
        total = 8 * (len(raw) + 8)

        def take(n: int) -> int:
            return (bits >> (total - at - n)) & ((1 << n) - 1)

        def signed(s: int) -> int:
            v = take(s)
            return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1

        blocks = np.zeros((down * across, 64))
        for block in blocks:
            w = take(16)
            at += int(dc_n[w])
            before += signed(int(dc[w]))
            at += int(dc[w])
            block[0] = before
            k = 1
            while k < 64:
                w = take(16)
                at += int(ac_n[w])
                run, s = divmod(int(ac[w]), 16)
                if s == 0 and run < 15:
                    break
                k += run
                if s:
                    block[order[k]] = signed(s)
                    at += s
                k += 1
        scaled = np.zeros_like(blocks)
        scaled[:, order] = blocks[:, order] * info["quant"][info["table"]]
        pixel = basis @ scaled.reshape(-1, 8, 8) @ basis.T + 128
        whole = pixel.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        out[f] = np.clip(np.rint(whole), 0, 255)[: info["height"], : info["width"]]
    return out


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame; frames with the same tables and size are decoded together."""
    groups: dict[bytes, list[int]] = {}
    scans = []
    for i, jpeg in enumerate(frames):
        head, at = _segments(jpeg)
        scans.append(jpeg[at:-2] if jpeg[-2:] == b"\xff\xd9" else jpeg[at:].rstrip(b"\0").removesuffix(b"\xff\xd9"))
        groups.setdefault(head, []).append(i)
    out: list = [None] * len(frames)
    for head, own in groups.items():
        decode = _decode_lossless if _read_head(head)["process"] == 0xC3 else _decode_baseline
        for i, samples in zip(own, decode(head, [scans[i] for i in own])):
            out[i] = samples
    return out


def shots(change: np.ndarray, reach: int = 8, factor: float = 3.0, least: float = 0.2) -> list[int]:
    """Frames that begin a shot: frame 0, and those whose change stands out from the changes around it.

    ``change[i]``: half the histogram difference of frames i and i + 1 as a share of a frame. A cut needs
    ``least``, and mean + ``factor`` * deviation of the ``reach`` changes to either side of it.
    """
    n = len(change)
    sums, squares = (np.concatenate(([0.0], np.cumsum(change**p))) for p in (1, 2))
    at = np.arange(n)
    low, high = np.maximum(0, at - reach), np.minimum(n, at + reach + 1)
    around = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - change) / around
    spread = np.sqrt(np.maximum(0, (squares[high] - squares[low] - change**2) / around - mean**2))
    return [0, *(np.flatnonzero((change >= least) & (change > mean + factor * spread)) + 1).tolist()]


def read_media(media: list[bytes]) -> Iterator[tuple[list[np.ndarray], list[int], float]]:
    """For each AVI file its frames, the frames that begin a shot, and frames a second."""
    found = [parse_riff(m) for m in media]
    frames = decode_frames([m[a:b] for m, (spans, _) in zip(media, found) for a, b in spans])
    alike = len({f.shape for f in frames}) <= 1
    if frames and alike:
        stack = np.stack(frames).reshape(len(frames), -1)
        row = np.arange(len(frames), dtype=np.int64)[:, None] * BINS
        histogram = np.bincount((row + (stack >> 4)).ravel(), minlength=len(frames) * BINS).reshape(-1, BINS) / stack.shape[1]
    else:
        histogram = np.array([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames]).reshape(-1, BINS)
    change = np.abs(np.diff(histogram, axis=0)).sum(1) / 2 if len(frames) else np.zeros(0)
    at = 0
    for spans, rate in found:
        n = len(spans)
        yield frames[at : at + n], shots(change[at : at + n - 1]) if n else [], rate
        at += n


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of a text (null: none), filled up with 255 to a positive multiple of a frame."""
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % FRAME or (0 if data else FRAME))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes long, media binary``: each whole text as an AVI file of lossless 24 x 24 grey frames.

    Null and empty texts are one frame of 255. Repeated rows and ids are kept.
    """

    def write(batches):
        for piece in slices(batches, "text", 1 << 20):
            data = [payload(t) for t in piece.column("text").to_pylist()]
            frames = encode_frames(np.frombuffer(b"".join(data), np.uint8).reshape(-1, SIDE, SIDE))
            files, at = [], 0
            for d in data:
                files.append(riff(frames[at : at + len(d) // FRAME]))
                at += len(d) // FRAME
            size = pa.array([len((t or "").encode()) for t in piece.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("id"), size, pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(write, rows.select("id").schema.add("n_bytes", "long").add("media", "binary"))


def clip_rows(files: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each clip: ``id, clip int, begin_frame, end_frame int, begin_s, end_s double, mean_level double``.

    Null media and files without frames have no clips; other bytes raise ValueError.
    """

    def clips(batches):
        for piece in slices(batches, "media", 2 << 20):
            rows = []
            own = [(i, m) for i, m in zip(piece.column("id").to_pylist(), piece.column("media").to_pylist()) if m is not None]
            for (i, _), (frames, begins, rate) in zip(own, read_media([m for _, m in own])):
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(frames)])):
                    rows.append((i, k, a, b, a / rate if rate else None, b / rate if rate else None, float(np.mean([f.mean() for f in frames[a:b]]))))
            if rows:
                kinds = (piece.schema.field("id").type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "clip", "begin_frame", "end_frame", "begin_s", "end_s", "mean_level"])

    rows = files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = rows.select("id").schema.add("clip", "integer").add("begin_frame", "integer").add("end_frame", "integer").add("begin_s", "double").add("end_s", "double").add("mean_level", "double")
    return rows.mapInArrow(clips, schema)


def media_digests(files: DataFrame) -> DataFrame:
    """For ``id, n_bytes, media``: sizes and digests of the file and of the payload decoded from it, and its clips as a feature."""

    def read(batches):
        for piece in slices(batches, "media", 2 << 20):
            media = piece.column("media").to_pylist()
            rows = []
            for m, (frames, begins, rate) in zip(media, read_media(media)):
                data = b"".join(f.tobytes() for f in frames)
                feature = f"{len(frames)} frames at {rate:g}/s, clips from " + " ".join(map(str, begins))
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["id", "n_bytes", *names])

    schema = files.select("id", "n_bytes").schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    return files.select("id", "n_bytes", "media").mapInArrow(read, schema)
