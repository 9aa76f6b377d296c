"""Cleaning of cells, keys, targets and headers. Column in, Column out; no Python in the workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every code point Python counts as whitespace. Spark's own trim removes U+0020 only, and Java's \s knows six.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Names that mean a folder (none, one or two dots), and the characters no file name may hold.
UNSAFE_NAME = r'\A\.{0,2}\z|[<>:"/\\|?*\x00-\x1f]'

# A private code point that stands in for dotless i while letter case is folded.
PARKED = "\ue000"

# The fraction of a whole number that was stored as a decimal, such as 12345.0 or 12345.00.
DECIMAL_TAIL = r"(?U)\A(\d++)\.0+\z"

# Zeros in front of an all-digit key that go when leading zeros do not count; the last digit always stays.
LEADING_ZEROS = r"(?U)\A0+(?=\d+\z)"

# Printable ASCII without the full stop: nothing to clean in there. One look at such text, which is nearly all of it,
# saves the trimming, the replacing and the regular expressions.
PLAIN = r"\A[!-\-/-~]*+\z"
NOT_ASCII = r"[^\x00-\x7f]"


def clean_cell(value: Column | str, dtype: str = "string") -> Column:
    """Any cell as text: NULL is '', whole decimals lose the fraction, outer whitespace goes.

    ``dtype`` is the Spark type name of the cell, as found in ``DataFrame.dtypes``.
    """
    cell = F.col(value) if isinstance(value, str) else value
    if dtype in ("double", "float"):
        wide = cell.cast("double")
        # A cast of 1e7 to string gives 1.0E7, hence the detour over DECIMAL.
        whole = wide.try_cast("decimal(38,0)").cast("string")
        text = (
            F.when(F.isnan(wide), F.lit("nan"))
            .when(wide == float("inf"), F.lit("inf"))
            .when(wide == float("-inf"), F.lit("-inf"))
            .when(wide == F.rint(wide), F.coalesce(whole, cell.cast("string")))
            .otherwise(cell.cast("string"))
        )
        return F.coalesce(text, F.lit(""))
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(cell.cast("string"), F.lit(""))
    if dtype == "boolean":
        return F.coalesce(F.initcap(cell.cast("string")), F.lit(""))
    text = F.coalesce(cell.cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    return F.when(text.rlike(PLAIN), text).otherwise(F.regexp_replace(trimmed, DECIMAL_TAIL, "$1"))


def squeeze(text: Column) -> Column:
    """Text without any whitespace."""
    return F.when(text.rlike(PLAIN), text).otherwise(F.translate(text, WHITESPACE, ""))


def strip_zeros(key: Column) -> Column:
    """All-digit keys without leading zeros; a key of zeros only becomes a single zero."""
    return F.regexp_replace(key, LEADING_ZEROS, "")


def key_of_text(text: Column, zeros: bool = False) -> Column:
    """The match key of a cell that ``clean_cell`` has already turned into text."""
    key = F.upper(squeeze(text))
    return strip_zeros(key) if zeros else key


def clean_key(value: Column | str, dtype: str = "string", zeros: bool = False) -> Column:
    """The match key of any cell. Both sides of every match go through here."""
    return key_of_text(clean_cell(value, dtype), zeros)


def clean_target(value: Column | str, dtype: str = "string") -> Column:
    """The output name of any cell: whitespace goes, letter case and zeros stay."""
    return squeeze(clean_cell(value, dtype))


def is_safe_name(name: Column) -> Column:
    """True where the text can be a file name on every common system."""
    return ~name.rlike(UNSAFE_NAME)


def header_token(header: Column) -> Column:
    """A column header reduced to its lower-case ASCII letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), "[^a-z0-9]", "")


def fold_case(text: Column) -> Column:
    """Full Unicode case folding, so that names that collide on some file system compare equal.

    Lower case of upper case does nearly all of it. Catalyst shortens lower(upper(x)) to lower(x), so the two are kept
    apart by concat. Three letters need care: capital sharp s, dotless i (parked on a private code point), final sigma.
    """
    parked = F.translate(text, "ẞı", "ß" + PARKED)
    folded = F.translate(F.lower(F.concat(F.upper(parked), F.lit(""))), "ς" + PARKED, "σı")
    return F.when(text.rlike(NOT_ASCII), folded).otherwise(F.lower(text))


def clean_cells(table: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as clean text, each by its own type; the others are left as they are."""
    types = dict(table.dtypes)
    return table.withColumns({name: clean_cell(name, types[name]) for name in columns})
