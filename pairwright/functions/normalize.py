"""Record normalisation as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Street words, directions and role hints.
STREETS = {"avenue": "ave", "boulevard": "blvd", "circle": "cir", "court": "ct", "drive": "dr", "highway": "hwy", "lane": "ln", "parkway": "pkwy", "place": "pl", "road": "rd", "square": "sq", "street": "st", "terrace": "ter"}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
PHONE_HINTS = ("phone", "telephone", "tel", "mobile", "fax")
ADDRESS_HINTS = ("addr", "address", "street", "location")
#: Texts that count as missing when a delimited file is read.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


#: White space of any kind, as one text of characters.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Patterns of generic text and what stands for them, in this order.
_TEXT_STEPS = (
    (r"\\+'", "'"),
    (r"(?U)\s*&\s*", " and "),
    (r"[^a-z0-9#&/.'+\-]+", " "),
    (r"^[ ']+|[ ']+$", ""),
)
# The words that compression drops, before and after signs are dropped, and its patterns.
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "for", "in", "on", "at", "to", "with", "by", "from", "is", "it", "this", "that", "as"]
SHOP_WORDS = ["free", "shipping", "included", "certified", "refurbished", "brand", "item", "product", "please", "note", "click", "here", "more", "details", "information", "features", "description"]


def _whole_words(words: list[str]) -> str:
    """A pattern of whole words, which looks at a first letter before it looks for the edge of a word."""
    return rf"(?=[{''.join(sorted({w[0] for w in words}))}])\b(?:{'|'.join(words)})\b"


BOILERPLATE = (r"http\S+", r"www\.\S+", _whole_words(STOP_WORDS), r"[^\w\s]", _whole_words(SHOP_WORDS))
#: A token that carries signal once signs are gone: alphanumerics, groups of them joined by single underscores.
SIGNAL = r"(?i)^[a-z0-9]+(?:_[a-z0-9]+)*$"


def is_missing(column: Column, kind: T.DataType | None = None) -> Column:
    """Null, or NaN in a floating column."""
    return column.isNull() | F.isnan(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else column.isNull()


def without_nan(df: DataFrame) -> DataFrame:
    """Every missing value of a floating column as null."""
    kinds = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: F.when(~is_missing(F.col(f"`{c}`"), k), F.col(f"`{c}`")) for c, k in kinds.items()}) if kinds else df


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def clean(column: Column) -> Column:
    """As text, stripped; missing is the empty text."""
    return strip(F.coalesce(column.cast("string"), F.lit("")))


def bare(column: Column) -> Column:
    """As text as it stands; missing is the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def basic(column: Column) -> Column:
    return strip(F.lower(bare(column)))


def record_key(column: Column) -> Column:
    """An identifier as stripped text, its case kept."""
    return strip(column.cast("string"))


def text(column: Column) -> Column:
    """Generic text: lower case, quotes evened out, `&` as a word, other signs as spaces, no quotes at the ends."""
    start = F.translate(basic(column), '`"', "' ")
    return reduce(lambda c, step: F.regexp_replace(c, *step), _TEXT_STEPS, start)


def phone(column: Column) -> Column:
    return F.regexp_replace(bare(column), r"(?U)\D+", "")


def address(column: Column) -> Column:
    """Generic text with street words, then directions, in their short form."""
    tokens = F.filter(F.split(F.regexp_replace(text(column), "[.,]", " "), r"\s+"), lambda t: t != "")
    for table in (STREETS, DIRECTIONS):
        short = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        tokens = F.transform(tokens, _lookup(short))
    return F.array_join(tokens, " ")


def _lookup(table: Column):
    return lambda token: F.coalesce(F.try_element_at(table, token), token)


def role(name: str, whole_words: bool = True) -> str:
    """What a column holds by its name: phone, address or text.

    By default hints match parts of the name between signs and case changes, so `hotel_name` isn't a telephone;
    whole_words=False looks for hints anywhere in the lower-cased name.
    """
    parts = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", str(name)).lower()))
    found = (lambda hints: any(h in str(name).lower() for h in hints)) if not whole_words else (lambda hints: any(p == h or p.startswith(h) and h not in ("tel",) for p in parts for h in hints))
    return "phone" if found(PHONE_HINTS) else "address" if found(ADDRESS_HINTS) else "text"


BY_ROLE = {"phone": phone, "address": address, "text": text}


def cell(column: Column, name: str, whole_words: bool = True) -> Column:
    return BY_ROLE[role(name, whole_words)](column)


def records(df: DataFrame, skip: tuple[str, ...] = (), whole_words: bool = True) -> DataFrame:
    """Every column normalised by its role, but for `skip`: one projection."""
    return without_nan(df).select(*(F.col(f"`{c}`") if c in skip else cell(F.col(f"`{c}`"), c, whole_words).alias(c) for c in df.columns))


def basic_records(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    return without_nan(df).select(*(F.col(f"`{c}`") if c in skip else basic(F.col(f"`{c}`")).alias(c) for c in df.columns))


def without_boilerplate(column: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, f"(?iU){p}", " "), BOILERPLATE, bare(column))


def compressed(column: Column, min_tokens: int = 10) -> Column:
    """A text of at most min_tokens tokens lower-cased and stripped; of a longer one the tokens with signal, without
    boilerplate, once each (first spelling, any case counts as the same), or the cleaned text if none has any.

    Of equal tokens the first is kept by hash; those are sorted by (lower case, place), the first of each kept, and
    those sorted by place: n log n a text, within its row, by sort_array(), which evaluates no expression to compare.
    """
    value = lambda v, body: F.get(F.transform(F.array(v), body), F.lit(0))
    plain = bare(column)
    low = F.lower(plain)
    linked = F.contains(low, F.lit("http")) | F.contains(low, F.lit("www."))
    without_links = F.when(linked, reduce(lambda c, p: F.regexp_replace(c, f"(?iU){p}", " "), BOILERPLATE[:2], plain)).otherwise(plain)
    # Signs become blanks, so tokens are what stands between \W; one with signal is ASCII, so words to drop are told by their lower case.
    tokens = F.filter(F.array_distinct(F.split(without_links, r"(?U)\W+")), lambda t: t.rlike(SIGNAL) & ~F.lower(t).isin(STOP_WORDS + SHOP_WORDS))
    placed = F.sort_array(F.transform(tokens, lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("at"), t.alias("token"))))
    first = value(placed, lambda p: F.filter(p, lambda x, i: (i == 0) | (x["low"] != F.get(p, i - 1)["low"])))
    words = F.sort_array(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"))))
    kept = value(F.array_join(F.transform(words, lambda x: x["token"]), " "), lambda w: F.when(w == "", strip(without_boilerplate(column))).otherwise(w))
    head = F.split(plain, r"(?U)\s+", max(1, min_tokens + 2))  # a first piece may be empty, and the last is the rest
    short = F.size(F.filter(head, lambda t: t != "")) <= min_tokens
    return F.when(short, basic(column)).otherwise(kept)


def compress(df: DataFrame, columns: list[str], min_tokens: int = 10) -> DataFrame:
    """df with `columns` compressed: a projection, whatever the keys."""
    plain = without_nan(df)
    return plain.select(*(compressed(F.col(f"`{c}`"), min_tokens).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def compress_records(df: DataFrame, key: str, columns: list[str] | None = None, min_tokens: int = 10) -> DataFrame:
    return compress(df, columns or [c for c in df.columns if c != key], min_tokens)
