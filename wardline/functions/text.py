"""Text expressions with Python `str` semantics, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import settings

# The code points for which Python's str.isspace() holds.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# The same set as the body of a Java character class, under the (?U) flag.
WHITESPACE_CLASS = r"\s\x1c-\x1f"


def strip_text(text: Column | str) -> Column:
    """Remove white space from both ends."""
    return F.btrim(_col(text), F.lit(WHITESPACE))


def long_enough(text: Column | str, minimum: int = settings.MIN_TEXT_LENGTH) -> Column:
    """True for texts of at least `minimum` code points; null counts as too short."""
    return F.coalesce(F.length(_col(text)) >= minimum, F.lit(False))


def text_preview(text: Column | str, length: int = settings.PREVIEW_LENGTH) -> Column:
    return F.substring(_col(text), 1, length)


def token_set(text: Column | str) -> Column:
    """Distinct lower-cased tokens between white space, in order of first use; blank text gives []."""
    stripped = strip_text(F.lower(_col(text)))
    tokens = F.array_distinct(F.split(stripped, f"(?U)[{WHITESPACE_CLASS}]+"))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(tokens)


def sampling_key(row_key: Column | str, seed: int = settings.SEED, purpose: str = "sample") -> Column:
    """A uniform 32-digit hex key fixed by seed, purpose and row: the order of every seeded draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), _col(row_key).cast("string")))


def row_key(source_rank: Column, row_id: Column, turn: Column | None = None) -> Column:
    """A string that no other (source, row, turn) has, whatever text serves as an id; whole numbers keep their order.

    Every part is written so that none is the beginning of another, so parts can stand side by side. A whole number in its plain
    form (up to 25 digits, no zeros in front) is a letter for the number of digits and the digits, so numbers sort as numbers. Anything else, `007`,
    `-1` and UUIDs among it, sorts after them: `z`, the text with `~1` for `~`, and `~0`. Ids are compared as text: the number 7 and the text `7` are one id.

    A null part ends the job: rows without an id would be one row to every step that follows.
    """
    return F.concat(*[_key_part(part) for part in (source_rank, row_id, F.lit(0) if turn is None else turn)])


def _key_part(part: Column) -> Column:
    text = part.cast("string")
    digits = F.concat(F.char(F.lit(96) + F.length(text)), text)
    other = F.concat(F.lit("z"), F.replace(text, F.lit("~"), F.lit("~1")), F.lit("~0"))
    missing = F.raise_error(F.lit("a row without an id, a turn or a source rank")).cast("string")
    return F.when(text.rlike("^(0|[1-9][0-9]{0,24})$"), digits).when(text.isNotNull(), other).otherwise(missing)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
