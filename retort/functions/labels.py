"""Labels from sample names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first letter of a sample names its winery; these groups give what follows from it.
ORIGINS = {"Neuchâtel": "MN", "Geneva": "JL", "Valais": "H", "California": "U", "Oregon": "X", "Burgundy": "DEQPRZ", "Alsace": "CKWY"}
COUNTRIES = {"Switzerland": "MNJLH", "US": "UX", "France": "DEQPRZCKWY"}
CONTINENTS = {"Europe": "MNJLHDEQPRZCKWY", "North America": "UX"}
ORIGIN_NORTH = "DEQ"
BURGUNDY_SIDES = {"NB": "QRZ", "SB": "DEP"}
ESTATES = {"D": "DR", "B": "EQ", "T": "PZ"}


def letter(name: Column) -> Column:
    return F.substring(name, 1, 1)


def mapped(name: Column, groups: dict[str, str], strict: bool = False, default: str | None = None) -> Column:
    """The group that the first letter is in; unknown letters give ``default``, or an error if strict."""
    pairs = [F.lit(x) for group, letters in groups.items() for one in letters for x in (one, group)]
    found = F.try_element_at(F.create_map(*pairs), letter(name))
    if strict:
        return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown winery letter: "), letter(name)))).otherwise(found)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def country(name: Column) -> Column:
    return mapped(name, COUNTRIES, strict=True)


def continent(name: Column) -> Column:
    return mapped(name, CONTINENTS, strict=True)


def origin(name: Column, split_burgundy: bool = False) -> Column:
    """Region of the winery, or Unknown; Burgundy may be split into its north and south."""
    own = mapped(name, ORIGINS, default="Unknown")
    if not split_burgundy:
        return own
    side = F.when(letter(name).isin(*ORIGIN_NORTH), F.lit("Burgundy_North")).otherwise(F.lit("Burgundy_South"))
    return F.when(own == "Burgundy", side).otherwise(own)


def burgundy_side(name: Column) -> Column:
    """NB or SB for Burgundy's wineries, an error for others; another split than that of origin."""
    return mapped(name, BURGUNDY_SIDES, strict=True)


def estate(name: Column) -> Column:
    return F.coalesce(mapped(name, ESTATES), letter(name))


def year_suffix(name: Column) -> Column:
    return F.right(name, F.lit(2))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def base_id(name: Column) -> Column:
    """The name without its final replicate number."""
    return F.regexp_replace(name, "-[^-]*$", "")


def full_vintage(name: Column) -> Column:
    """Two digits after the letter, replicate taken off: over 50 in the last century."""
    yy = _found(base_id(name), r"^.(\d{2})").cast("int")
    return F.when(yy > 50, 1900 + yy).otherwise(2000 + yy)


def press_year(name: Column) -> Column:
    yy = _found(name, r"Est(\d{2})").cast("int")
    return F.when(yy >= 20, 2000 + yy).when(yy.isNotNull(), 1900 + yy)


def press_class(name: Column) -> Column:
    return _found(name, r"([ABC])(?=\d)")


def press_composite(name: Column) -> Column:
    return _found(name, r"([A-C]\d+)")


def bordeaux_label(name: Column, by_year: bool = False) -> Column:
    """The letter before a four-digit year, or letter and year; null without a year."""
    return _found(name, r"(.\d{4})") if by_year is False else _found(name, r"(\d{4})")


def bordeaux_split_label(name: Column, by_year: bool = False) -> Column:
    return _found(name, r"(.\d{4})") if by_year else name


def chateau_letter(name: Column) -> Column:
    """The character before the first digits, one underscore between them passed over."""
    return _found(name, r"^\D*?(\D)_?\d")


def from_first_digit(name: Column) -> Column:
    """The name from its first digit on, or null."""
    return _found(name, r"(\d.*)$")


def strategy_label(name: Column, kind: str, by_year: bool = False) -> Column:
    """What a wine kind takes as label: the first character, four digits, or the whole name."""
    if kind == "bordeaux" and by_year:
        return _found(name, r"(\d{4})")
    return letter(name) if kind in ("bordeaux", "press_wines") else name


def alphabetic_prefix(name: Column) -> Column:
    return F.coalesce(_found(name, "^([A-Za-z]+)"), name)


def first_number_at(name: Column) -> Column:
    """Place of the first digit, from 0, or -1."""
    return F.regexp_instr(name, F.lit(r"\d")) - 1


def last_number_at(name: Column) -> Column:
    """Place of the first digit of the last number, from 0, or -1."""
    head = _found(name, r"^((?:.*\D)?)\d+\D*$")
    return F.coalesce(F.length(head), F.lit(-1))


def renamed(name: Column) -> Column:
    """Folder names ML_<name>.D to Est21<name>.D: replicate 1 is added where none is, underscores become hyphens; others stay."""
    rest = F.substring(name, 4, 1 << 20)
    numbered = F.when(rest.rlike(r"_\d+(?=\.D$)"), rest).otherwise(F.replace(rest, F.lit(".D"), F.lit("_1.D")))
    return F.when(name.startswith("ML_"), F.replace(F.concat(F.lit("Est21"), numbered), F.lit("_"), F.lit("-"))).otherwise(name)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w\-.()+]", "_")


def wine_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in ("bordeaux", "pinot_noir", "press_wines", "champagne")])


def age_bin(age: Column, edges: list[float]) -> Column:
    """How many edges are at or below the value: left-closed bins."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= age))


def equal_width_bin(value: Column, low: Column, high: Column, n: int) -> Column:
    """Bin of n equal ones between low and high, clipped at both ends."""
    raw = F.floor((value - low) / F.when(high > low, high - low).otherwise(1.0) * n)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1)).cast("int")


def unit_norm(values: Column) -> Column:
    """The array divided by its Euclidean norm; a zero array stays."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(values, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def shift_edge_fill(values: Column, by: int) -> Column:
    """Roll an array; what leaves one end is replaced by the edge value at the other."""
    n = F.size(values)
    if by >= 0:
        return F.concat(F.array_repeat(F.get(values, F.lit(0)), F.least(F.lit(by), n)), F.slice(values, F.lit(1), F.greatest(n - by, F.lit(0))))
    return F.concat(F.slice(values, F.least(F.lit(1 - by), n + 1), n), F.array_repeat(F.get(values, n - 1), F.least(F.lit(-by), n)))


def natural_key(name: Column) -> Column:
    """Sort key that puts T2 before T10."""
    return F.struct(F.regexp_replace(name, r"\d+", ""), F.coalesce(_found(name, r"(\d+)").cast("long"), F.lit(-1)))


def class_rank(label: Column, order: list[str]) -> Column:
    """Place in a given order of classes; others come behind, by name."""
    at = F.array_position(F.array(*map(F.lit, order)), label)
    return F.struct(F.when(at > 0, at).otherwise(len(order) + 1), label)
