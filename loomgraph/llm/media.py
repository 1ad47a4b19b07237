"""Media columns: ISO base media files, their boxes, sample tables and keyframe ranges."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a sample; payloads are padded with blanks to a positive multiple of it.
UNIT = 192
#: Samples of a chunk, and from one keyframe to the next.
PER_CHUNK, PER_KEY = 64, 16
TIMESCALE, PER_SAMPLE = 48_000, 192
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, fmt: str, *values: int, version: int = 0, rest: bytes = b"") -> bytes:
    return box(kind, struct.pack(">I" + fmt, version << 24, *values), rest)


def stored(payload: bytes) -> bytes:
    """The payload as 8-bit samples of one track: ftyp, mdat, moov with its sample tables."""
    n = len(payload) // UNIT
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")
    data = box(b"mdat", payload)
    at = len(head) + len(data) - len(payload)
    chunks = [at + i * UNIT for i in range(0, n, PER_CHUNK)]
    last = n - (len(chunks) - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] if len(chunks) > 1 else []
    if not runs or last != PER_CHUNK:
        runs.append((len(chunks), last, 1))
    keys = range(1, n + 1, PER_KEY)
    flat = lambda rows: b"".join(struct.pack(f">{len(r)}I", *r) for r in rows)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    table = box(
        b"stbl",
        _full(b"stsd", "I", 1, rest=entry),
        _full(b"stts", "III", 1, n, PER_SAMPLE),
        _full(b"stss", "I", len(keys), rest=flat((k,) for k in keys)),
        _full(b"stsc", "I", len(runs), rest=flat(runs)),
        _full(b"stsz", "II", UNIT, n),
        _full(b"co64", "I", len(chunks), rest=struct.pack(f">{len(chunks)}Q", *chunks)),
    )
    long_ = n * PER_SAMPLE
    media = box(b"mdia", _full(b"mdhd", "IIIIHH", 0, 0, TIMESCALE, long_ & 0xFFFFFFFF, 0x55C4, 0), _full(b"hdlr", "I4s12x", 0, b"soun", rest=b"\0"), box(b"minf", _full(b"smhd", "I", 0), table))
    return head + data + box(b"moov", _full(b"mvhd", "IIII", 0, 0, TIMESCALE, long_ & 0xFFFFFFFF, rest=bytes(80)), box(b"trak", media))


#: Levels of boxes that are walked. Sample tables are on the fifth.
LEVELS = 32


def walk(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(path, first, end) of the boxes' bodies, containers before their content, down to LEVELS. A broken size ends the walk of its container."""
    open_ = [(0, len(data), "")]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                continue
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            continue
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, start + size
        open_.append((start + size, end, path))
        if kind in CONTAINERS and len(open_) < LEVELS:
            open_.append((body, start + size, name))


def tracks(data: bytes) -> list[dict[str, tuple[int, int]]]:
    """Of each track, in the file's order, the first box of each path below it."""
    out: list[dict] = []
    for name, i, j in walk(data):
        if name == "/moov/trak":
            out.append({})
        elif name.startswith("/moov/trak/"):
            out[-1].setdefault(name, (i, j))
    return out


def described(data: bytes, track: int = 0) -> dict:
    """Codec, timescale, duration, sample ranges and keyframes of a track; payloads aren't read.

    Raises where there is no such track, or its boxes contradict each other or point outside the file. Fragmented files hold no sample
    tables and so raise too.
    """
    boxes = tracks(data)[track]
    table = "/moov/trak/mdia/minf/stbl/"
    ints = lambda name, skip=4: struct.unpack_from(f">{(boxes[name][1] - boxes[name][0] - skip) // 4}I", data, boxes[name][0] + skip)
    codec = data[boxes[table + "stsd"][0] + 12 : boxes[table + "stsd"][0] + 16].decode("latin-1")
    i, _ = boxes["/moov/trak/mdia/mdhd"]
    (scale,) = struct.unpack_from(">I", data, i + (20 if data[i] == 1 else 12))  # version 1 has 64-bit times before it
    fixed, n, *sizes = ints(table + "stsz")
    if n * fixed > len(data) or (not fixed and len(sizes) < n):
        raise ValueError("more samples than the file holds")
    sizes = [fixed] * n if fixed else sizes[:n]
    if table + "co64" in boxes:
        i, _ = boxes[table + "co64"]
        offsets = struct.unpack_from(f">{struct.unpack_from('>I', data, i + 4)[0]}Q", data, i + 8)
    else:
        offsets = ints(table + "stco")[1:]
    runs = ints(table + "stsc")[1:]
    firsts = [*runs[::3], len(offsets) + 1]
    samples, k = [], 0
    for r, per in enumerate(runs[1::3]):
        for chunk in range(firsts[r], firsts[r + 1]):
            at = offsets[chunk - 1]
            for size in sizes[k : k + per]:
                samples.append((at, size))
                at += size
            k += per
            if k > n or at > len(data):
                raise ValueError("samples outside the file")
    times = ints(table + "stts")[1:]
    duration = sum(a * b for a, b in zip(times[::2], times[1::2]))
    keys = ints(table + "stss")[1:] if table + "stss" in boxes else range(1, n + 1)
    return {"codec": codec, "timescale": scale, "duration": duration, "samples": samples, "keyframes": [samples[x - 1] for x in keys]}


def read_back(data: bytes, samples: list[tuple[int, int]]) -> bytes:
    return b"".join(data[i : i + n] for i, n in samples)


def feature(d: dict) -> str:
    """codec, duration in ticks and timescale, samples, and a digest of the keyframes' byte ranges with their count."""
    ranges = ",".join(f"{i}+{n}" for i, n in d["keyframes"])
    return f"codec={d['codec'].strip()};duration={d['duration']}/{d['timescale']};samples={len(d['samples'])};keyframes={len(d['keyframes'])}:{hashlib.sha256(ranges.encode()).hexdigest()[:16]}"


RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
#: What a file's boxes say of it: codec, seconds, samples, and the byte ranges of its keyframes.
COLUMNS = {"codec": pa.string(), "seconds": pa.float64(), "samples": pa.int64(), "keyframes": RANGES}
COLUMNS_SQL = "codec string, seconds double, samples long, keyframes array<struct<offset:long,size:long>>"


def columns_of(d: dict) -> tuple:
    return d["codec"].strip(), d["duration"] / d["timescale"], len(d["samples"]), [{"offset": i, "size": n} for i, n in d["keyframes"]]


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *COLUMNS]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = (text or "").encode()
            payload = raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")
            media = stored(payload)
            d = described(media)
            back = read_back(media, d["samples"])
            rows.append((doc, len(raw), len(back), sha(back), zlib.crc32(back[-16:]), len(media), sha(media), feature(d), *columns_of(d)))
        columns = list(zip(*rows)) or [()] * len(NAMES)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *COLUMNS.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)


def stored_and_read(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): its text stored as a media file, read back through the sample tables, its features and media columns.

    Rows are independent: nothing is shuffled. A null text is empty and becomes one sample of blanks;
    equal texts give equal values; other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + COLUMNS_SQL
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests, schema)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for raw in b.column(1).to_pylist():
            try:
                rows.append(columns_of(described(raw or b"")))
            except (KeyError, struct.error, IndexError, ValueError, ZeroDivisionError):
                rows.append((None, None, None, None))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, COLUMNS.values()))], ["id", *COLUMNS])


def media_columns(files: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """(id, codec, seconds, samples, keyframes) of the first track of binary files; null columns where a file is null or no ISO media file."""
    rows = files.select(F.col(id).alias("id"), F.col(content).alias("content"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_columns, f"id {kind}, {COLUMNS_SQL}")
