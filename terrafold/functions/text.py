"""Text, date and cell parsing as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and the letters they fold to.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
#: Month names in Spanish.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: Words a street name may begin with, which carry no meaning.
PARTICLES = ("DE", "DEL", "LA", "LAS", "EL", "LOS")


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_tags(s: Column) -> Column:
    return squeeze(F.regexp_replace(s, "<[^>]*>", " "))


def unescape(s: Column) -> Column:
    """The five named entities of XML and the blank."""
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(value))
    return s


def fold(s: Column) -> Column:
    """Lower case without marks, blanks squeezed."""
    return squeeze(F.lower(F.translate(s, MARKED, PLAIN)))


def cosmetic_key(s: Column) -> Column:
    return squeeze(F.upper(F.translate(s, MARKED, PLAIN)))


def canonical_key(s: Column) -> Column:
    """Upper case, blanks squeezed, marks kept: the key of an official identifier; missing is the empty key."""
    return squeeze(F.upper(F.coalesce(s, F.lit(""))))


def ascii_key(s: Column) -> Column:
    """Lower case without marks, blanks inside kept as they are; missing is the empty key."""
    return F.trim(F.lower(F.translate(F.coalesce(s, F.lit("")), MARKED, PLAIN)))


def street_key(s: Column) -> Column:
    """The cosmetic key without leading particles, however many."""
    return F.regexp_replace(cosmetic_key(s), f"^(({'|'.join(PARTICLES)}) )+", "")


def padded_code(s: Column, width: int) -> Column:
    return F.lpad(F.trim(s.cast("string")), width, "0")


def cell_state(s: Column) -> Column:
    """(state, value) of a published cell: blank, a number or something else are three things, and zero is a number."""
    plain = F.trim(s)
    number = F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")
    state = F.when(plain.isNull() | (plain == ""), "NOT_PUBLISHED").when(number.isNull(), "NOT_PUBLISHED_NON_NUMERIC").otherwise("PUBLISHED")
    return F.struct(state.alias("state"), F.when(state == "PUBLISHED", number).alias("value"))


def decimal_comma(s: Column, precision: int = 9, scale: int = 4) -> Column:
    """12,5 -> 12.5; null for anything else."""
    return F.when(F.trim(s).rlike(r"^-?[0-9]+(,[0-9]+)?$"), F.replace(F.trim(s), F.lit(","), F.lit(".")).cast(f"decimal({precision},{scale})"))


def thousands(s: Column) -> Column:
    """1.234.567 -> 1234567; null for anything else."""
    return F.when(F.trim(s).rlike(r"^[0-9]{1,3}(\.[0-9]{3})*$"), F.replace(F.trim(s), F.lit("."), F.lit("")).cast("long"))


def spanish_date(s: Column) -> Column:
    """'3 de mayo de 2024' -> date."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(F.lower(s), r"de ([a-z]+) de", 1))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", F.regexp_extract(s, "de ([0-9]{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(s, "^([0-9]{1,2}) de", 1), 2, "0"))))


def any_date(s: Column, *formats: str) -> Column:
    """The first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats))


def is_month(s: Column) -> Column:
    return s.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$")


def delta_text(n: Column) -> Column:
    """+n, n or 0."""
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def canonical(*columns: str) -> Column:
    """One line a row: JSON with the fields in order of name and nulls kept, so that text and missing values differ."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def address_signature(kind: Column, name: Column, number: Column, qualifier: Column) -> Column:
    """(kind, name, number) of an address, folded; two addresses agree where all three do."""
    text = lambda c: F.coalesce(cosmetic_key(c), F.lit(""))
    return F.struct(text(kind).alias("kind"), street_key(F.coalesce(name, F.lit(""))).alias("name"), F.concat(text(number), text(qualifier)).alias("number"))


def header_name(name: str) -> str:
    """A column name from a published header: without marks, in lower case, words joined by one underscore."""
    plain = name.strip().lstrip("\ufeff").translate(str.maketrans(MARKED, PLAIN)).lower()
    return re.sub("[^a-z0-9]+", "_", plain).strip("_")
