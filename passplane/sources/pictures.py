"""Picture files as a Spark data source: PNG, and binary PGM and PPM; and as a sink for PNG.

``register(spark)`` makes ``spark.read.format("pictures").load(folder)`` known: a row (path, height, width, bgr, error) a file, one partition for each
group of files of about ``bytesPerPartition``. bgr holds blue, green and red of each pixel, row by row; of a file that cannot be read it
is null and error says why. The folder must be mounted on driver and executors; pictures of other stores are read as bytes (`images.image_files`)
and decoded by `decoded`. A picture is held whole by one task, and never larger than its file's header says.
"""

from __future__ import annotations

import fnmatch
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from passplane.sources.folders import mounted

SCHEMA = "path string, height int, width int, bgr binary, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format: samples a pixel by kind (grey, colour, places of a palette, and with transparency) and the depths allowed.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Rows of pixels leave Python by at most so many, of one picture or of several.
PIXELS_A_BATCH = 100_000


class Unreadable(ValueError):
    """A file that is no picture, or not one that this module reads."""


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of a PNG's parts, each checked."""
    at = len(_SIGNATURE)
    while True:
        if at + 12 > len(content):
            raise Unreadable("the file ends early")
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data, check = content[at + 8 : at + 8 + size], content[at + 8 + size : at + 12 + size]
        if len(data) < size or len(check) < 4:
            raise Unreadable("the file ends early")
        if zlib.crc32(kind + data) != int.from_bytes(check, "big"):
            raise Unreadable(f"a part of kind {kind.decode('latin-1')} is damaged")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size


def _between(left: int, up: int, corner: int) -> int:
    """Of three neighbours the one nearest to left + up - corner."""
    guess = left + up - corner
    apart = abs(guess - left), abs(guess - up), abs(guess - corner)
    return left if apart[0] <= apart[1] and apart[0] <= apart[2] else up if apart[1] <= apart[2] else corner


def _unfiltered(kind: int, line: np.ndarray, before: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from what is stored, given the row before; step: bytes of a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + before
    if kind not in (3, 4):
        raise Unreadable(f"unknown row filter {kind}")
    out, up = line.tolist(), before.tolist()
    for k in range(len(out)):
        left, corner = (out[k - step], up[k - step]) if k >= step else (0, 0)
        out[k] = (out[k] + ((left + up[k]) // 2 if kind == 3 else _between(left, up[k], corner))) % 256
    return np.array(out, np.uint8)


def _png(content: bytes) -> np.ndarray:
    """(height, width, 3) blue, green, red."""
    header, palette, packed = None, None, []
    for kind, data in _chunks(content):
        if kind == b"IHDR" and len(data) == 13:
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(data)
    if header is None:
        raise Unreadable("no header")
    width, height, depth, kind, _, _, laced = header
    if not width or not height or depth not in _DEPTHS.get(kind, ()):
        raise Unreadable("a header that makes no sense")
    if laced:
        raise Unreadable("interlaced pictures are not read")
    samples = _SAMPLES[kind]
    stride, step = -(-width * samples * depth // 8), max(1, samples * depth // 8)
    opened = zlib.decompressobj()
    try:
        raw = opened.decompress(b"".join(packed), height * (stride + 1))
    except zlib.error as damaged:
        raise Unreadable("damaged pixels") from damaged
    if len(raw) < height * (stride + 1):
        raise Unreadable("pixels are missing")
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    rows, before = np.empty((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for k in range(height):
        before = rows[k] = _unfiltered(int(lines[k, 0]), lines[k, 1:], before, step)
    if depth == 16:
        values = rows.reshape(height, width, samples, 2)[..., 0]
    elif depth == 8:
        values = rows.reshape(height, width, samples)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width]
        values = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[..., None]
        if kind == 0:
            values = (values.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if kind == 3:
        if palette is None or int(values.max()) >= len(palette):
            raise Unreadable("a colour that the palette lacks")
        values = palette[values[..., 0]]
    elif samples <= 2:
        values = np.repeat(values[..., :1], 3, axis=2)
    return values[..., 2::-1]


def _portable(content: bytes) -> np.ndarray:
    """Of a binary PGM or PPM."""
    header = re.match(rb"P[56]\s+(\d+)\s+(\d+)\s+\d+\s", content)
    if header is None:
        raise Unreadable("a header that makes no sense")
    width, height, depth = int(header[1]), int(header[2]), 3 if content[:2] == b"P6" else 1
    data = content[header.end() :][: width * height * depth]
    if not data or len(data) < width * height * depth:
        raise Unreadable("pixels are missing")
    picture = np.frombuffer(data, np.uint8).reshape(height, width, depth)
    return picture[:, :, ::-1] if depth == 3 else np.repeat(picture, 3, axis=2)


def decode(content: bytes) -> np.ndarray:
    """(height, width, 3) blue, green, red of a picture's bytes; raises Unreadable."""
    if content.startswith(_SIGNATURE):
        return _png(content)
    if content[:2] in (b"P5", b"P6"):
        return _portable(content)
    raise Unreadable("unknown format" if content else "empty")


def encode(picture: np.ndarray, filters: int = 0) -> bytes:
    """A PNG of (height, width) grey values or (height, width, 3) blue, green, red; every row with one of the filters 0 to 4."""
    values = picture[..., ::-1] if picture.ndim == 3 else picture[..., None]
    height, width, samples = values.shape
    rows = np.ascontiguousarray(values, np.uint8).reshape(height, -1).astype(np.int64)
    left = np.pad(rows, ((0, 0), (samples, 0)))[:, :-samples]
    up, corner = np.pad(rows, ((1, 0), (0, 0)))[:-1], np.pad(left, ((1, 0), (0, 0)))[:-1]
    guess = left + up - corner
    a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    stored = (rows - (0, left, up, (left + up) // 2, nearest)[filters]) % 256
    lines = np.concatenate([np.full((height, 1), filters), stored], axis=1).astype(np.uint8).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if samples == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def row_of(path: str, content: bytes) -> tuple:
    """A row of SCHEMA."""
    try:
        picture = decode(content)
    except Unreadable as why:
        return path, None, None, None, str(why)
    return path, *picture.shape[:2], np.ascontiguousarray(picture).tobytes(), None


@dataclass
class Files(InputPartition):
    """The files of one partition."""

    paths: list[str]


class PictureReader(DataSourceReader):
    """Lists files on the driver, by name and size alone, and decodes them in tasks."""

    def __init__(self, options: dict[str, str]):
        self.root, self.pattern, self.size = mounted(options["path"]), options.get("pattern", "*"), int(options.get("bytesPerPartition", 64 << 20))

    def partitions(self) -> list[Files]:
        """Files in order of their paths, in groups of about the wanted size; a larger file is alone."""
        groups, held = [Files([])], 0
        for folder, inner, names in os.walk(self.root):
            inner.sort()
            for name in sorted(fnmatch.filter(names, self.pattern)):
                path = os.path.join(folder, name)
                size = os.path.getsize(path)
                if groups[-1].paths and held + size > self.size:
                    groups.append(Files([]))
                    held = 0
                groups[-1].paths.append(path)
                held += size
        return groups

    def read(self, partition: Files) -> Iterator[tuple]:
        """A row a file; one that has gone or may not be read gives an error row too."""
        for path in partition.paths:
            try:
                with open(path, "rb") as file:
                    content = file.read()
            except OSError as why:
                yield path, None, None, None, f"not read: {why.strerror}"
                continue
            yield row_of(path, content)


class PictureSource(DataSource):
    """See the module; options: path, pattern, bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return PictureReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(PictureSource)


def decoded(images: DataFrame) -> DataFrame:
    """The rows of SCHEMA for files as bytes (path, content), from any store."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                yield pd.DataFrame([row_of(path, bytes(content))], columns=["path", "height", "width", "bgr", "error"]).astype({"height": "Int32", "width": "Int32"})

    return images.select("path", "content").mapInPandas(run, SCHEMA)


def _stretches(sizes: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """(picture, first pixel, end) of pictures of these sizes: many small ones together, or a part of a large one."""
    held, n = [], 0
    for k, size in enumerate(sizes):
        for a in range(0, size, PIXELS_A_BATCH):
            b = min(a + PIXELS_A_BATCH, size)
            if n + b - a > PIXELS_A_BATCH:
                yield held
                held, n = [], 0
            held.append((k, a, b))
            n += b - a
    if held:
        yield held


def pixels(pictures: DataFrame, outer: bool = False) -> DataFrame:
    """(path, y, x, b, g, r) of rows of SCHEMA; unreadable ones have none. outer: with height, width and error after the path, and an unreadable one has
    one row, without pixel."""
    kept = ["path", "height", "width", "error"] if outer else ["path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read, unread = pdf[pdf.error.isna()], pdf[pdf.error.notna()]
            own, widths, all_bgr = {c: read[c].to_numpy() for c in kept}, read.width.to_numpy(np.int32), list(read.bgr)
            for held in _stretches([len(bgr) // 3 for bgr in all_bgr]):
                which = np.repeat([k for k, _, _ in held], [b - a for _, a, b in held])
                flat = np.frombuffer(b"".join(all_bgr[k][3 * a : 3 * b] for k, a, b in held), np.uint8).reshape(-1, 3).astype(np.int32)
                y, x = np.divmod(np.concatenate([np.arange(a, b, dtype=np.int32) for _, a, b in held]), widths[which])
                yield pd.DataFrame({c: values[which] for c, values in own.items()} | {"y": y, "x": x, **{c: flat[:, k] for k, c in enumerate("bgr")}})
            if len(unread):
                yield unread[kept].assign(**dict.fromkeys(["y", "x", *"bgr"]))

    rows = pictures if outer else pictures.where("error IS NULL")
    types = {"path": "string", "height": "int", "width": "int", "error": "string"}
    return rows.select("path", "height", "width", "bgr", "error").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", y int, x int, b int, g int, r int")


def write(pictures: DataFrame, folder: str) -> DataFrame:
    """Writes a PNG for each row (path, width, bgr, filters), path below the folder, and gives (path, length). Each file is written under another name and then
    renamed, so a lost task leaves no half of one. Lazy: files are written when the result is."""
    root = mounted(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = []
            for path, width, bgr, filters in zip(pdf.path, pdf.width, pdf.bgr, pdf.filters, strict=True):
                content = encode(np.frombuffer(bgr, np.uint8).reshape(-1, int(width), 3), int(filters))
                place = os.path.join(root, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(f"{place}.{os.getpid()}.new", "wb") as file:
                    file.write(content)
                os.replace(f"{place}.{os.getpid()}.new", place)
                sizes.append(len(content))
            yield pd.DataFrame({"path": pdf.path, "length": sizes})

    return pictures.select("path", "width", "bgr", "filters").mapInPandas(run, "path string, length long")
