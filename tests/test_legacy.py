"""Legacy workbooks, written here record by record and read through Spark."""

from __future__ import annotations

import datetime as dt
import struct

import pytest
from pyspark.errors import PySparkException

from terrafold.sources.legacy import editions_of, read_legacy_workbooks, sheets

HEADER = ["Código", "Fase", "m2", "Activo"]


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(s, wide=False):
    return struct.pack("<HB", len(s), int(wide)) + s.encode("utf-16-le" if wide else "latin-1")


def workbook(date="Datos a 3 de mayo de 2024", header=HEADER, split=False):
    strings = [date, *header, "APE.01", "Añadido", "日本", "x" * 40]
    body = struct.pack("<II", 9, len(strings)) + b"".join(text(s, any(ord(c) > 255 for c in s)) for s in strings)
    shared = record(0xFC, body)
    if split:  # inside the last string; the rest begins with its own flags and goes on in wide characters
        shared = record(0xFC, body[:-15]) + record(0x3C, b"\x01" + ("x" * 15).encode("utf-16-le"))
    cell = lambda kind, row, column, rest: record(kind, struct.pack("<HHH", row, column, 0) + rest)
    of = {s: i for i, s in enumerate(strings)}
    label = lambda row, column, s: cell(0xFD, row, column, struct.pack("<I", of[s]))
    sheet = record(0x809, b"\0" * 16) + label(0, 0, date) + b"".join(label(2, i, h) for i, h in enumerate(header))
    sheet += label(3, 0, "APE.01") + label(3, 1, "Añadido") + cell(0x203, 3, 2, struct.pack("<d", 12.5)) + cell(0x205, 3, 3, b"\1\0")
    sheet += label(4, 0, "日本") + record(0xBD, struct.pack("<HH", 4, 1) + struct.pack("<HI", 0, 7 << 2 | 2) + struct.pack("<HI", 0, 1250 << 2 | 3) + struct.pack("<H", 2))
    sheet += cell(0x06, 5, 0, b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(0x207, text("formula")) + cell(0x06, 5, 2, struct.pack("<d", 9.0) + b"\0" * 8)
    sheet += cell(0x27E, 6, 2, struct.pack("<I", struct.unpack("<Q", struct.pack("<d", -3.0))[0] >> 32)) + label(6, 0, "x" * 40) + record(0x0A)
    name = "Hoja 1"
    globals_ = lambda at: record(0x809, b"\0" * 16) + record(0x85, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name.encode()) + shared + record(0x0A)
    return globals_(len(globals_(0))) + sheet


def compound(stream, pad=0):
    """A compound file with the stream in whole sectors, or in small ones inside the root's."""
    stream += b"\0" * pad
    small = len(stream) < 4096
    sectors = -(-len(stream) // 512)
    entry = lambda name, kind, first, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind) + b"\0" * 49 + struct.pack("<III", first, size, 0)
    end, free, table = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD
    chain = [i + 1 for i in range(3, 3 + sectors - 1)] + [end]
    fat = ([table, end, end] + chain + [free] * 128)[:128]
    links = list(range(1, -(-len(stream) // 64))) + [end]
    small_fat = struct.pack("<128I", *(links + [free] * 128)[:128])
    directory = entry("Root Entry", 5, 3 if small else end, len(stream) if small else 0) + entry("Workbook", 2, 0 if small else 3, len(stream))
    head = (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6)).ljust(44, b"\0")
    head += struct.pack("<IIIIIIII", 1, 1, 0, 4096, 2 if small else end, 1 if small else 0, end, 0)
    head += struct.pack("<109I", 0, *[free] * 108)
    return head.ljust(512, b"\0") + struct.pack("<128I", *fat) + directory.ljust(512, b"\0") + small_fat + stream.ljust(512 * sectors, b"\0")


@pytest.mark.parametrize("pad", [0, 5000])
@pytest.mark.parametrize("split", [False, True])
def test_cells_of_every_kind(pad, split):
    got = list(sheets(compound(workbook(split=split), pad)))
    assert got == [
        ("Hoja 1", 0, ["Datos a 3 de mayo de 2024"]),
        ("Hoja 1", 2, HEADER),
        ("Hoja 1", 3, ["APE.01", "Añadido", "12.5", "true"]),
        ("Hoja 1", 4, ["日本", "7", "12.5"]),
        ("Hoja 1", 5, ["formula", None, "9"]),
        ("Hoja 1", 6, ["x" * 40, None, "-3"]),
    ]


def test_an_edition_states_its_date_and_has_the_pinned_header(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(compound(workbook(), 5000))
    (tmp_path / "b.xls").write_bytes(compound(workbook("A 21 DE AGOSTO DE 2023")))
    got = editions_of(read_legacy_workbooks(spark, f"{tmp_path}/*.xls"), HEADER).collect()
    assert {(r.path[-5:], r.reference_date) for r in got} == {("a.xls", dt.date(2024, 5, 3)), ("b.xls", dt.date(2023, 8, 21))}
    first = next(r for r in got if r.row == 3)
    assert (first["Código"], first.Fase, first.m2, first.Activo) == ("APE.01", "Añadido", "12.5", "true")
    assert len(got) == 8
    for bad, why in ((workbook(header=["Fase", "Código", "m2", "Activo"]), "another header"), (workbook("sin fecha"), "no reference date")):
        (tmp_path / "c.xls").write_bytes(compound(bad))
        with pytest.raises(PySparkException, match=why):
            editions_of(read_legacy_workbooks(spark, f"{tmp_path}/*.xls"), HEADER).select("row").collect()
    (tmp_path / "c.xls").write_bytes(b"PK not a compound file")
    with pytest.raises(PySparkException, match="not a compound file"):
        read_legacy_workbooks(spark, f"{tmp_path}/c.xls").collect()
