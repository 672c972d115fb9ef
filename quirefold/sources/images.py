"""Image files by extension, and the embedded previews of raw photographs, found by walking their TIFF directories."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import file_extension

EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "dng", "pdf")
MOST_BYTES, MOST_ENTRIES, MOST_DEPTH, LEAST_EDGE = 512 << 20, 4096, 4, 1024
#: TIFF tags and the sizes of field types; fixed values.
WIDTH, HEIGHT, COMPRESSION, STRIPS, STRIP_BYTES, ORIENTATION, SUB_IFDS, JPEG_AT, JPEG_BYTES = 256, 257, 259, 273, 279, 274, 330, 513, 514
MAKE = 271
#: Makers whose raw files hold previews that can be used; fixed values.
MAKERS = ("apple",)
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 13: 4}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files of known extensions with their bytes."""
    return spark.read.format("binaryFile").load(path).filter(file_extension(F.col("path")).isin(*EXTENSIONS))


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The integer fields of every directory of a TIFF file, subdirectories too; loops and excesses end the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or len(data) > MOST_BYTES or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return
    todo, seen, entries = [(struct.unpack_from(order + "I", data, 4)[0], 0)], set(), 0
    while todo:
        at, depth = todo.pop(0)
        if at in seen or depth > MOST_DEPTH or not 0 < at <= len(data) - 2:
            continue
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        entries += n
        if entries > MOST_ENTRIES or at + 2 + 12 * n > len(data):
            return
        fields: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = SIZES.get(kind)
            if not size or kind in (2, 5, 7) or count > MOST_ENTRIES:
                continue
            where = at + 2 + 12 * i + 8
            if size * count > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if where + size * count <= len(data):
                fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 2: 'H', 4: 'I'}[size]}", data, where))
        yield fields
        todo += [(x, depth + 1) for x in fields.get(SUB_IFDS, [])]
        after = at + 2 + 12 * n
        if after + 4 <= len(data) and (following := struct.unpack_from(order + "I", data, after)[0]):
            todo.append((following, depth))


def maker(data: bytes) -> str:
    """The camera's maker by the first directory of a TIFF file; empty where there is none."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return ""
    at = struct.unpack_from(order + "I", data, 4)[0]
    n = struct.unpack_from(order + "H", data, at)[0] if 0 < at <= len(data) - 2 else 0
    for i in range(min(n, MOST_ENTRIES)):
        where = at + 2 + 12 * i
        if where + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, where)
        if tag == MAKE and kind == 2:
            start = where + 8 if count <= 4 else struct.unpack_from(order + "I", data, where + 8)[0]
            return data[start : start + min(count, 256)].split(b"\0")[0].decode("latin-1").strip()
    return ""


def raw_fault(data: bytes) -> str | None:
    """Why a raw photograph can't be used: not a TIFF file, another maker, no preview of a good size; None if it can."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return "format"
    if maker(data).lower() not in MAKERS:
        return "maker"
    return None if best_preview(data) else "preview"


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a JPEG's frame header."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def best_preview(data: bytes) -> tuple[int, int, int, int, int] | None:
    """(offset, bytes, width, height, orientation) of the largest embedded JPEG with a long edge of 1024 or more."""
    found, turn = [], 1
    for fields in directories(data):
        turn = fields.get(ORIENTATION, [turn])[0]
        places = list(zip(fields.get(JPEG_AT, []), fields.get(JPEG_BYTES, [])))
        if fields.get(COMPRESSION, [0])[0] in (6, 7) and len(fields.get(STRIPS, [])) == 1:
            places += list(zip(fields[STRIPS], fields.get(STRIP_BYTES, [])))
        for at, n in places:
            if at + n <= len(data) and (size := jpeg_size(data[at : at + n])) and max(size) >= LEAST_EDGE:
                found.append((size[0] * size[1], at, n, *size))
    if not found:
        return None
    _, at, n, w, h = max(found, key=lambda f: (f[0], -f[1]))
    turn = turn if 1 <= turn <= 8 else 1
    return (at, n, h, w, turn) if turn >= 5 else (at, n, w, h, turn)


def previews(files: DataFrame) -> DataFrame:
    """(path, fault, offset, bytes, width, height, orientation) of raw photographs: the usable preview, or why there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                fault = raw_fault(data := bytes(content))
                rows.append((path, fault, *(best_preview(data) if fault is None else [None] * 5)))
            yield pd.DataFrame(rows, columns=["path", "fault", "offset", "bytes", "width", "height", "orientation"])

    return files.filter(file_extension(F.col("path")) == "dng").select("path", "content").mapInPandas(run, "path string, fault string, offset long, bytes long, width long, height long, orientation int")
