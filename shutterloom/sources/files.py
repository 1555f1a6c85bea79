"""Files in: directory walks, tag vocabularies, tensors, image headers and bytes. Files out: snapshots, tensors, text."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
from collections import OrderedDict
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterloom.operators.filters import is_excluded, is_media
from shutterloom.session import exists, ship, versions, written

TAGS = T.StructType([T.StructField(n, T.StringType(), False) for n in ("term", "kind", "source", "sensitivity")])
TAG_KINDS, TAG_SENSITIVITY = ("simple", "subject", "vibe"), ("safe", "sensitive", "blocked")
LARGEST_IMAGE, LARGEST_REQUEST, LARGEST_PIXELS = 16 << 20, 32 << 20, 40_000_000


def walk(spark: SparkSession, root: str, exclude: list[str] | None = None, recursive: bool = True, contents: bool = False) -> DataFrame:
    """path, source_modified_ns, source_size (and content) of the media below a root. Without contents only listings are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = files.select(path.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("source_modified_ns"), F.col("length").alias("source_size"), *(["content"] if contents else []))
    return rows.where(is_media(F.col("path")) & ~is_excluded(F.col("path"), exclude or []))


LISTED = "path string, source_modified_ns long, source_size long, is_folder boolean, problem string"


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """path, source_modified_ns, source_size, is_folder, problem of what is below a root, level by level, the folders of a
    level listed in parallel. Links are followed (a folder reached twice is listed once), excluded folders are pruned, also
    where a link leads into one, and what cannot be read is a row with its problem: with any such row the walk is incomplete."""
    skip = [e.rstrip("/") for e in exclude or []]

    def hidden(path: str) -> bool:
        parts = path.split("/")
        return any(p == ".cache" or p.startswith(".thumb") for p in parts) or any(path == e or path.startswith(e + "/") for e in skip)

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                try:
                    entries = list(os.scandir(folder))
                except OSError as e:
                    rows.append((folder, None, None, True, " ".join(str(e).split())))
                    continue
                for entry in entries:
                    if hidden(entry.path) or hidden(os.path.realpath(entry.path)):
                        continue
                    try:
                        at = entry.stat()
                        rows.append((entry.path, at.st_mtime_ns, at.st_size, entry.is_dir(), None))
                    except OSError as e:
                        rows.append((entry.path, None, None, False, " ".join(str(e).split())))
            yield pd.DataFrame(rows, columns=["path", "source_modified_ns", "source_size", "is_folder", "problem"]).astype({"source_modified_ns": "Int64", "source_size": "Int64"})

    found, known, here = spark.createDataFrame([], LISTED), {os.path.realpath(root)}, [root.rstrip("/") or "/"]
    while here:  # one step for each level of folders; only names of folders come to the driver
        rows = written(spark.createDataFrame([(p,) for p in here], "path string").repartition(min(len(here), 1000)).mapInPandas(level, LISTED))
        found = found.unionByName(rows)
        deeper = [r.path for r in rows.where("is_folder AND problem IS NULL").select("path").toLocalIterator()] if recursive else []
        here = [p for p in deeper if (real := os.path.realpath(p)) not in known and not known.add(real)]
    media = found.where(F.col("is_folder") | F.col("problem").isNotNull() | is_media(F.col("path")))
    return media if limit is None else media.orderBy("path").limit(limit)


def is_complete(found: DataFrame) -> bool:
    """Whether a listing met nothing that it could not read."""
    return not found.where(F.col("problem").isNotNull()).limit(1).count()


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated vocabulary with the fixed header; a row with another number of fields, or an unknown kind or
    sensitivity, is an error."""
    rows = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(TAGS).csv(path)
    known = F.col("kind").isin(*TAG_KINDS) & F.col("sensitivity").isin(*TAG_SENSITIVITY)
    return rows.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown tag class: "), F.concat_ws("/", "kind", "sensitivity")))))


def read_tensors(path: str) -> dict[str, np.ndarray]:
    """A safetensors file: half and single floats, as float32."""
    kinds = {"F16": np.float16, "F32": np.float32}
    with open(path, "rb") as f:
        head = json.loads(f.read(struct.unpack("<Q", f.read(8))[0]))
        body = f.read()
    out = {}
    for name, t in head.items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            out[name] = np.frombuffer(body[a:b], kinds[t["dtype"]]).reshape(t["shape"]).astype(np.float32)
    return out


def tensor_bytes(tensors: dict[str, np.ndarray]) -> bytes:
    """The same format, single floats, names in order."""
    head, body = {}, b""
    for name, t in sorted(tensors.items()):
        data = np.ascontiguousarray(t, np.float32).tobytes()
        head[name] = {"dtype": "F32", "shape": list(t.shape), "data_offsets": [len(body), len(body) + len(data)]}
        body += data
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + body


def tag_matrix(spark: SparkSession, tags: DataFrame, matrix: np.ndarray) -> DataFrame:
    """The vocabulary (a static table that fits the driver by nature) with one embedding a row, in file order."""
    rows = tags.collect()
    if len(rows) != len(matrix):
        raise ValueError("the matrix and the vocabulary differ in length")
    schema = T.StructType([*TAGS.fields, T.StructField("embedding", T.ArrayType(T.FloatType(), False))])
    return spark.createDataFrame([(*r, v.tolist()) for r, v in zip(rows, matrix)], schema)


def external_images(encoded: list[str], known: OrderedDict[str, bytes] | None = None) -> list[tuple[str, bytes]]:
    """(SHA-256, bytes) of base64 images in a request, within the limits of bytes and pixels. ``known`` keeps the last 32
    by their hash, the least recently used go first."""
    out, total = [], 0
    for text in encoded:
        data = base64.b64decode(text, validate=True)
        total += len(data)
        if not data or len(data) > LARGEST_IMAGE or total > LARGEST_REQUEST:
            raise ValueError("an external image is empty or too large")
        head = probe_header(data)
        if (head["width"] or 0) * (head["height"] or 0) > LARGEST_PIXELS:
            raise ValueError("an external image has too many pixels")
        name = hashlib.sha256(data).hexdigest()
        if known is not None:
            known[name] = data
            known.move_to_end(name)
            while len(known) > 32:
                known.popitem(last=False)
        out.append((name, data))
    return out


def decode_vector(blob: bytes) -> list[float]:
    """Little-endian single floats."""
    if len(blob) % 4:
        raise ValueError("a vector has whole floats")
    return np.frombuffer(blob, "<f4").tolist()


def encode_vector(vector: list[float]) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


PROBED = "path string, source_modified_ns long, source_size long, media_kind string, media_format string, width int, height int, is_animated boolean, frame_count int, duration_ms long, taken string, taken_offset string"
#: EXIF fields of the capture time and its zone, in order of preference (fixed values).
TAKEN, TAKEN_OFFSET, EXIF_FOLDER = (0x9003, 0x132), (0x9011, 0x9010), 0x8769


def probe_header(data: bytes) -> dict:
    """Kind, format, size, frames and duration by the magic bytes of PNG, JPEG, GIF, WebP and BMP."""
    out: dict = {"media_kind": "image", "media_format": None, "width": None, "height": None, "is_animated": False, "frame_count": None, "duration_ms": None, "taken": None, "taken_offset": None}
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        out |= {"media_format": "png"} | dict(zip(("width", "height"), struct.unpack(">II", data[16:24])))
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        frames, delay = gif_frames(data)
        out |= {"media_format": "gif", "frame_count": frames, "is_animated": frames > 1, "duration_ms": delay if frames > 1 else None} | dict(zip(("width", "height"), struct.unpack("<HH", data[6:10])))
    elif data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        out |= {"media_format": "bmp", "width": w, "height": abs(h)}
    elif data[:2] == b"\xff\xd8":
        out |= {"media_format": "jpeg"} | jpeg_size(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        out |= {"media_format": "webp"} | webp_size(data)
    elif data[4:8] == b"ftyp":
        out |= {"media_kind": "video", "media_format": "mov" if data[8:10] == b"qt" else "mp4"} | movie_head(data)
    elif data[:4] == b"\x1a\x45\xdf\xa3":
        out |= {"media_kind": "video", "media_format": "webm" if b"webm" in data[:64] else "mkv"}
    return out


def gif_frames(data: bytes) -> tuple[int, int]:
    """Frames and their total time in ms (a delay is in hundredths of a second)."""
    at = 13 + (3 << ((data[10] & 7) + 1) if data[10] & 0x80 else 0)
    frames, delay = 0, 0

    def skip_blocks(i: int) -> int:
        while i < len(data) and data[i]:
            i += data[i] + 1
        return i + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1 : at + 3] == b"\xf9\x04":
                delay += struct.unpack("<H", data[at + 4 : at + 6])[0] * 10
            at = skip_blocks(at + 2)
        elif data[at] == 0x2C and at + 10 <= len(data):
            frames += 1
            local = data[at + 9]
            at = skip_blocks(at + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            break
    return frames, delay


def jpeg_size(data: bytes) -> dict:
    """Width and height from the frame header, sides swapped for a turned EXIF orientation; the capture time as EXIF has it."""
    at, turned, taken = 2, False, {}
    while at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            fields = exif_fields(data[at + 10 : at + 2 + size])
            turned = fields.get(0x112, 1) in (5, 6, 7, 8)
            taken = {"taken": next((fields[k] for k in TAKEN if k in fields), None), "taken_offset": next((fields[k] for k in TAKEN_OFFSET if k in fields), None)}
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return ({"width": h, "height": w} if turned else {"width": w, "height": h}) | taken
        at += 2 + size
    return taken


def exif_fields(tiff: bytes) -> dict:
    """Whole numbers and texts of the first folder and its EXIF folder."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    out: dict = {}
    if not order or len(tiff) < 10:
        return out
    folders = [struct.unpack(order + "I", tiff[4:8])[0]]
    for at in folders:
        count = struct.unpack(order + "H", tiff[at : at + 2])[0] if at + 2 <= len(tiff) else 0
        for i in range(count):
            entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            if kind == 3:
                out.setdefault(tag, struct.unpack(order + "H", entry[8:10])[0])
            elif kind == 2:
                where = struct.unpack(order + "I", entry[8:12])[0]
                out.setdefault(tag, (entry[8 : 8 + n] if n <= 4 else tiff[where : where + n]).split(b"\0")[0].decode("ascii", "replace"))
            elif kind == 4 and tag == EXIF_FOLDER and len(folders) == 1:
                folders.append(struct.unpack(order + "I", entry[8:12])[0])
    return out


def movie_head(data: bytes) -> dict:
    """Size, duration and creation time from the boxes of an MP4 or MOV file, as far as they are in the data."""
    out: dict = {}

    def boxes(start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while start + 8 <= end:
            size, kind = struct.unpack(">I4s", data[start : start + 8])
            head = 8
            if size == 1:
                size, head = struct.unpack(">Q", data[start + 8 : start + 16])[0], 16
            size = size or end - start
            if size < head:
                return
            yield kind, start + head, min(end, start + size)
            start += size

    for kind, a, b in boxes(0, len(data)):
        if kind != b"moov":
            continue
        for inner, c, d in boxes(a, b):
            if inner == b"mvhd":
                wide = data[c] == 1
                made, _, scale, length = struct.unpack(">QQIQ" if wide else ">IIII", data[c + 4 : c + (32 if wide else 20)])
                out["duration_ms"] = length * 1000 // scale if scale else None
                if made > 2_082_844_800:  # its years count from 1904
                    out["taken"] = datetime.fromtimestamp(made - 2_082_844_800, timezone.utc).strftime("%Y:%m:%d %H:%M:%S")
            elif inner == b"trak":
                for part, e, f in boxes(c, d):
                    if part == b"tkhd" and f - e >= 84:
                        w, h = (v >> 16 for v in struct.unpack(">II", data[f - 8 : f]))
                        if w and h:
                            turn = struct.unpack(">i", data[f - 40 : f - 36])[0]  # the matrix's second value: not 0 for a quarter turn
                            out |= {"width": h, "height": w} if turn else {"width": w, "height": h}
    return out


def webp_size(data: bytes) -> dict:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        side = lambda b: int.from_bytes(b, "little") + 1
        return {"width": side(data[24:27]), "height": side(data[27:30]), "is_animated": bool(data[20] & 2)}
    if kind == b"VP8L" and len(data) >= 25:
        bits = int.from_bytes(data[21:25], "little")
        return {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1}
    if kind == b"VP8 " and len(data) >= 30:
        w, h = struct.unpack("<HH", data[26:30])
        return {"width": w & 0x3FFF, "height": h & 0x3FFF}
    return {}


def probe(files: DataFrame) -> DataFrame:
    """Headers of walked files (with content), by Arrow batches; a file that cannot be read has null sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                try:
                    rows.append(probe_header(data or b""))
                except (struct.error, IndexError):
                    rows.append(probe_header(b""))
            head = pd.DataFrame(rows, columns=["media_kind", "media_format", "width", "height", "is_animated", "frame_count", "duration_ms", "taken", "taken_offset"], index=pdf.index)
            out = pd.concat([pdf.drop(columns="content"), head], axis=1)
            yield out.astype({c: "Int64" for c in ("width", "height", "frame_count", "duration_ms")})

    ship(files.sparkSession)
    return files.mapInPandas(run, PROBED)


def publish(df: DataFrame, folder: str, name: str) -> str:
    """Write a new snapshot and return its path; readers that hold the old path keep their view of it. Any file system."""
    at = f"{folder.rstrip('/')}/{name}"
    path = f"{at}/v{max(versions(df.sparkSession, at), default=0) + 1}"
    df.write.parquet(path)
    return path


def latest(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The last snapshot that was written completely; None before the first."""
    at = f"{folder.rstrip('/')}/{name}"
    whole = [v for v in versions(spark, at) if exists(spark, f"{at}/v{v}/_SUCCESS")]
    return spark.read.parquet(f"{at}/v{max(whole)}") if whole else None


def text_lines(hits: DataFrame) -> DataFrame:
    """value: escaped text, a tab, the path: for write.text. Backslashes, quotes, tabs, line ends and other control
    characters are escaped, so a line stays a line."""
    text = F.col("content")
    for plain, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"'), ("'", "\\'"), ("\0", "\\0")):
        text = F.replace(text, F.lit(plain), F.lit(escape))
    for code in [*range(1, 32), 127]:
        if chr(code) not in "\n\r\t":
            text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u{{{code:x}}}"))
    return hits.select(F.concat_ws("\t", text, "source_path").alias("value"))
