"""Media columns: AVI files of lossless motion-JPEG frames, their index, their samples and their shots."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievewright.llm.texts import raw_bytes, slices

WIDTH, HEIGHT, RATE = 32, 18, 25
FRAME = WIDTH * HEIGHT
#: A difference of size category s takes 9 - s bits of Huffman code and s more: every sample takes nine bits.
SAMPLE_BITS = 9
BINS = 16
#: Shots: a histogram difference begins one if it passes the local mean by so many deviations, and the floor.
DEVIATIONS, FLOOR, AROUND = 3.0, 0.12, 8
#: Frames that are coded at once: a frame's bits take some 5 kB on the way.
AT_ONCE = 4096


def _symbols() -> np.ndarray:
    """The nine bits of each difference -255..255: a canonical Huffman code of its size, then its value."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        prefix = (1 << (SAMPLE_BITS - size)) - 2  # 0, 10, 110, ... from size 8 down
        out[d + 255] = (prefix << size) | (d if d > 0 else d + (1 << size) - 1)
    return out


_SYMBOL = _symbols()
_SYMBOL_BITS = ((_SYMBOL[:, None] >> np.arange(SAMPLE_BITS - 1, -1, -1)) & 1).astype(np.uint8)
_DIFFERENCE = np.zeros(1 << SAMPLE_BITS, np.int16)
_DIFFERENCE[_SYMBOL] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Lossless sequential JPEG (SOF3): one component of 8 bits, one table (sizes 8 to 0 in codes of 1 to 9 bits), predictor 1.
JPEG_HEAD = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
)
JPEG_TAIL = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """``(n, HEIGHT, WIDTH)`` bytes -> ``n`` JPEG images without loss."""
    if len(samples) > AT_ONCE:
        return [image for k in range(0, len(samples), AT_ONCE) for image in encode_frames(samples[k : k + AT_ONCE])]
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    bits = _SYMBOL_BITS[d.reshape(len(x), FRAME) + 255].reshape(len(x), FRAME * SAMPLE_BITS)
    packed = np.packbits(bits, axis=1)
    return [JPEG_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + JPEG_TAIL for row in packed]


def parse_jpeg(image: bytes) -> tuple[int, int, dict[tuple[int, int], int], int]:
    """Height, width, Huffman codes ``(bits, code) -> size`` and where the entropy-coded data begin."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    at, height, width, codes = 2, 0, 0, {}
    while True:
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        if marker == 0xC3:
            height, width = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            code, k = 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    codes[bits, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1 is read")
            return height, width, codes, at + 2 + size
        at += 2 + size


def _decode_any(data: bytes, codes: dict, n: int) -> np.ndarray:
    """Differences by the image's own Huffman table, bit by bit, for images of other writers."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    out, at = np.zeros(n, np.int16), 0
    for i in range(n):
        length, code = 0, 0
        while (length, code) not in codes:
            code = code << 1 | bits[at]
            length, at = length + 1, at + 1
        size = codes[length, code]
        value = int("".join(map(str, bits[at : at + size])) or "0", 2)
        at += size
        out[i] = value if not size or value >> (size - 1) else value - (1 << size) + 1
    return out


def _integrated(d: np.ndarray) -> np.ndarray:
    """Differences of frames of one size -> samples."""
    d = d.copy()
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


def decode_frames(images: list[bytes]) -> np.ndarray | list[np.ndarray]:
    """JPEG images -> ``(n, HEIGHT, WIDTH)`` samples, all at once if they have this writer's table; else a list, each of its own size."""
    if not all(x.startswith(JPEG_HEAD) for x in images):
        out = []
        for x in images:
            height, width, codes, at = parse_jpeg(x)
            out.append(_integrated(_decode_any(x[at:-2].replace(b"\xff\x00", b"\xff"), codes, height * width).reshape(1, height, width))[0])
        return out
    parts = [np.zeros((0, HEIGHT, WIDTH), np.uint8)]
    for k in range(0, len(images), AT_ONCE):
        packed = b"".join(x[len(JPEG_HEAD) : -2].replace(b"\xff\x00", b"\xff") for x in images[k : k + AT_ONCE])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, SAMPLE_BITS)
        symbol = (bits[:, 0].astype(np.uint16) << 8) | np.packbits(bits[:, 1:], axis=1)[:, 0]
        parts.append(_integrated(_DIFFERENCE[symbol].reshape(-1, HEIGHT, WIDTH)))
    return np.concatenate(parts)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(images: list[bytes]) -> bytes:
    """A RIFF AVI file with one motion-JPEG stream and its ``idx1`` index."""
    most = max(map(len, images), default=0)
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(images), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, RATE, 0, len(images), most, -1, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    movie, index, at = [b"movi"], [], 4
    for x in images:
        movie.append(b"00dc" + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(movie[-1])
    body = b"AVI " + head + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """The images that the file's index lists, and the seconds of a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movie, index, seconds = 12, 0, b"", 1 / RATE
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            seconds = struct.unpack("<I", media[at + 20 : at + 24])[0] / 1e6
        elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return [media[movie + o + 8 : movie + o + 8 + n] for _, flags, o, n in struct.iter_unpack("<4sIII", index) if flags & 0x10], seconds


def shots(frames: np.ndarray | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First frames of shots, and the histogram difference of each frame to the one before.

    The threshold follows the differences around a frame: their mean and deviation over eight frames
    to either side, the frame's own left out. No frames have no shots.
    """
    n = len(frames)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    if isinstance(frames, list):
        hist = np.stack([np.bincount(x.ravel() >> 4, minlength=BINS) / x.size for x in frames])
    else:
        hist = np.bincount((np.arange(n)[:, None] * BINS + (frames.reshape(n, -1) >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / FRAME
    d = np.r_[0.0, np.abs(np.diff(hist, axis=0)).sum(1) / 2]
    if n < 2:
        return np.zeros(1, np.int64), d
    lo, hi = np.maximum(np.arange(n) - AROUND, 1), np.minimum(np.arange(n) + AROUND + 1, n)
    s1, s2 = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    others = np.maximum(hi - lo - 1, 1)
    mean = (s1[hi] - s1[lo] - d) / others
    deviation = np.sqrt(np.maximum((s2[hi] - s2[lo] - d * d) / others - mean**2, 0))
    cut = d > np.maximum(FLOOR, mean + DEVIATIONS * deviation)
    cut[0] = True
    return np.flatnonzero(cut), d


def encode(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_bytes, media``: the text's UTF-8 bytes, padded by 255 to whole frames, as an AVI file.

    Defined cases: null and empty texts are one frame of padding; repeated rows are encoded each; a null
    ``doc_id`` stays null; long texts are coded some thousand frames at a time; a file must fit a Spark value (2 GiB, and
    so RIFF's 32-bit sizes); an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = raw_bytes(batch.column("text"))
            size = np.diff(offsets)
            count = np.maximum(1, -(-size // FRAME))
            first = np.r_[0, np.cumsum(count)]
            padded = np.full(first[-1] * FRAME, 255, np.uint8)
            padded[np.arange(len(data)) + np.repeat(first[:-1] * FRAME - offsets[:-1], size)] = data
            images = encode_frames(padded.reshape(-1, HEIGHT, WIDTH))
            media = [write_avi(images[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list, list[float]]]:
    """Batches with their media and each one's frames; what is null or no AVI file has no frames."""
    for batch in slices(batches, "media"):
        media = [x.as_py() or b"" for x in batch.column("media")]
        read = [read_avi(m) if m[:4] == b"RIFF" and m[8:12] == b"AVI " else ([], 1 / RATE) for m in media]
        first = np.r_[0, np.cumsum([len(images) for images, _ in read])]
        images = [x for images, _ in read for x in images]
        if all(x.startswith(JPEG_HEAD) for x in images):
            frames = decode_frames(images)
            own = [frames[a:b] for a, b in zip(first[:-1], first[1:])]
        else:
            own = [decode_frames(images) for images, _ in read]
        yield batch, media, own, [s for _, s in read]


def clips(media: DataFrame) -> DataFrame:
    """``media(doc_id, media)`` -> a row per shot: ``doc_id, clip, first_frame, frames, begins, ends, change``, times in seconds.

    Defined cases: null media and what is no AVI file have no frames and no clips; frames may differ in size; of equal
    differences each passes the threshold or none; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, frames, seconds in _opened(batches):
            rows = []
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                own = frames[i]
                begin, d = shots(own)
                for k, (a, b) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(own)])):
                    rows.append((key, k, a, b - a, a * seconds[i], b * seconds[i], float(d[a])))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "clip", "first_frame", "frames", "begins", "ends", "change"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id bigint, clip int, first_frame bigint, frames bigint, begins double, ends double, change double")


def digests(media: DataFrame) -> DataFrame:
    """``media(doc_id, n_bytes, media)`` -> what the stored bytes give when read back: digests of the payload and a feature of the shots.

    Defined cases: null media and what is no AVI file have an empty payload and no frames; frames may differ in size; an
    empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media_, frames, _ in _opened(batches):
            rows = []
            for own, m in zip(frames, media_):
                payload = own.tobytes() if isinstance(own, np.ndarray) else b"".join(x.tobytes() for x in own)
                begin, d = shots(own)
                mean = np.frombuffer(payload, np.uint8).mean() if payload else 0.0
                feature = f"frames={len(own)};shots={len(begin)};peak={d.max(initial=0.0):.4f};mean={mean:.3f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
