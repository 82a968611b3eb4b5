"""Legacy workbooks (compound files of BIFF8 records): cells as rows, and the edition that a sheet says it is."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.functions.text import MONTHS, spanish_date
from terrafold.runtime import ship

#: Fixed values of the format: marks, special sectors and the numbers of records.
_MARK = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST_SECTOR = 0xFFFFFFFA
_BOF, _EOF, _SHEET, _CONTINUE, _STRINGS = 0x809, 0x0A, 0x85, 0x3C, 0xFC
_TEXT, _LABEL, _NUMBER, _RK, _MANY_RK, _FORMULA, _RESULT, _TRUTH = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205

ROWS = "path string, sheet string, row int, cells array<string>"


def _chain(table: list[int], first: int) -> Iterator[int]:
    seen = 0
    while first < _LAST_SECTOR:
        yield first
        first, seen = table[first], seen + 1
        if seen > len(table):
            raise ValueError("a chain of sectors never ends")


def workbook_stream(raw: bytes) -> bytes:
    """The records of a workbook, by following the sectors of its compound file."""
    if raw[:8] != _MARK:
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
    directory, cutoff, small_table, _, more, _ = struct.unpack_from("<I4xIIIII", raw, 48)
    sector = lambda i: raw[512 + i * size : 512 + (i + 1) * size]
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b))
    listed = numbers(raw[76:512])
    while more < _LAST_SECTOR:
        *part, more = numbers(sector(more))
        listed += part
    table = [n for i in listed if i < _LAST_SECTOR for n in numbers(sector(i))]
    whole = lambda first: b"".join(map(sector, _chain(table, first)))
    entries = whole(directory)
    inner = b""
    for at in range(0, len(entries), 128):
        entry = entries[at : at + 128]
        name = entry[: max(0, struct.unpack_from("<H", entry, 64)[0] - 2)].decode("utf-16-le")
        first, length = struct.unpack_from("<II", entry, 116)
        if entry[66] == 5:
            inner = whole(first)
        elif name in ("Workbook", "Book"):
            if length >= cutoff:
                return whole(first)[:length]
            links = numbers(whole(small_table))
            return b"".join(inner[i * small : (i + 1) * small] for i in _chain(links, first))[:length]
    raise ValueError("the compound file holds no workbook")


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + length]
        at += 4 + length


def _plain(raw: bytes, at: int, count: int) -> str:
    """Characters of one string that lies in one piece; at: its flags."""
    return raw[at + 1 : at + 1 + 2 * count].decode("utf-16-le") if raw[at] & 1 else raw[at + 1 : at + 1 + count].decode("latin-1")


def _shared(pieces: list[bytes]) -> list[str]:
    """The table of shared strings; where a piece ends inside a string, the next begins with flags of its own."""
    unique = struct.unpack_from("<I", pieces[0], 4)[0]
    piece, at, out = 0, 8, []
    for _ in range(unique):
        if at >= len(pieces[piece]):
            piece, at = piece + 1, 0
        count, flags = struct.unpack_from("<HB", pieces[piece], at)
        at += 3
        runs = struct.unpack_from("<H", pieces[piece], at)[0] if flags & 8 else 0
        at += 2 if flags & 8 else 0
        extra = struct.unpack_from("<I", pieces[piece], at)[0] if flags & 4 else 0
        at += 4 if flags & 4 else 0
        text, wide = "", flags & 1
        while True:
            fits = min(count - len(text), (len(pieces[piece]) - at) // (2 if wide else 1))
            end = at + fits * (2 if wide else 1)
            text += pieces[piece][at:end].decode("utf-16-le" if wide else "latin-1", "surrogatepass")
            at = end
            if len(text) >= count or piece + 1 >= len(pieces):
                break
            piece, at, wide = piece + 1, 1, pieces[piece + 1][0] & 1
        skip = 4 * runs + extra
        while skip > len(pieces[piece]) - at and piece + 1 < len(pieces):
            skip, piece, at = skip - (len(pieces[piece]) - at), piece + 1, 0
        at += skip
        out.append(text)
    return out


def _rk(n: int) -> float:
    value = float((n ^ 0x80000000) - 0x80000000 >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return value / 100 if n & 1 else value


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _cells(kind: int, r: bytes, strings: list[str]) -> list[tuple[int, int, str | None]]:
    """(row, column, text) of a cell's record; a formula whose text follows has none yet."""
    row, column = struct.unpack_from("<HH", r)
    if kind == _TEXT:
        return [(row, column, strings[struct.unpack_from("<I", r, 6)[0]])]
    if kind == _LABEL:
        return [(row, column, _plain(r, 8, struct.unpack_from("<H", r, 6)[0]))]
    if kind == _NUMBER:
        return [(row, column, _number(struct.unpack_from("<d", r, 6)[0]))]
    if kind == _RK:
        return [(row, column, _number(_rk(struct.unpack_from("<I", r, 6)[0])))]
    if kind == _MANY_RK:
        return [(row, column + i, _number(_rk(struct.unpack_from("<I", r, 6 + 6 * i)[0]))) for i in range((len(r) - 6) // 6)]
    if kind == _TRUTH:
        return [(row, column, None if r[7] else str(bool(r[6])).lower())]
    if r[12:14] == b"\xff\xff":
        return [(row, column, str(bool(r[8])).lower() if r[6] == 1 else None)]
    return [(row, column, _number(struct.unpack_from("<d", r, 6)[0]))]


def sheets(raw: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of each row that has any."""
    stream = workbook_stream(raw)
    names, pieces, own = [], [], None
    for kind, r in _records(stream):
        if kind == _SHEET:
            names.append((struct.unpack_from("<I", r)[0], _plain(r, 7, r[6])))
        if kind == _STRINGS or (kind == _CONTINUE and own == _STRINGS):
            pieces.append(r)
        own = own if kind == _CONTINUE else kind
        if kind == _EOF:
            break
    strings = _shared(pieces) if pieces else []
    for start, name in names:
        rows: dict[int, dict[int, str | None]] = {}
        last = None
        for kind, r in _records(stream, start):
            if kind == _EOF:
                break
            if kind in (_TEXT, _LABEL, _NUMBER, _RK, _MANY_RK, _TRUTH, _FORMULA):
                for row, column, text in _cells(kind, r, strings):
                    rows.setdefault(row, {})[column] = text
                    last = row, column
            elif kind == _RESULT and last:
                rows[last[0]][last[1]] = _plain(r, 2, struct.unpack_from("<H", r)[0])
        for row, held in sorted(rows.items()):
            yield name, row, [held.get(c) for c in range(max(held) + 1)]


def read_legacy_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row of each sheet of each workbook; a workbook is read by one task."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in sheets(bytes(content))], columns=["path", "sheet", "row", "cells"])

    return files.mapInPandas(run, ROWS)


def editions_of(rows: DataFrame, header: list[str]) -> DataFrame:
    """(path, sheet, reference_date, row, and a column for each name of the header) of workbooks whose sheets have exactly this header, in order.

    The reference date is the one that a cell above the header states in words. A sheet
    without the header or without a date fails the job; it is never dropped.
    """
    same = F.col("cells") == F.array(*map(F.lit, header))
    words = rf"(?i)([0-9]{{1,2}} de (?:{'|'.join(MONTHS)}) de [0-9]{{4}})"
    stated = F.array_compact(F.transform("cells", lambda c: spanish_date(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), words, 1)))))
    w = Window.partitionBy("path", "sheet")
    at = F.min(F.when(same, F.col("row"))).over(w)
    placed = rows.withColumns({"at": at, "stated": F.get(stated, F.lit(0))})
    dated = placed.withColumn("reference_date", F.max(F.when(F.col("row") < F.col("at"), F.col("stated"))).over(w))
    wrong = F.when(F.col("at").isNull(), "has another header").when(F.col("reference_date").isNull(), "states no reference date")
    failed = F.raise_error(F.concat("path", F.lit(" "), "sheet", F.lit(" "), wrong)).cast("boolean")
    good = dated.where(F.when(wrong.isNull(), F.col("row") > F.col("at")).otherwise(failed))
    return good.select("path", "sheet", "reference_date", "row", *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(header)))
