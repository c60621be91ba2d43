"""Line-oriented text as column expressions: all evaluated inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 29 characters that strip() takes off, as a class.
WHITE_SPACE = r"[\p{javaWhitespace}\x85\xa0\u2007\u202f]"
MISSING = "missing"


def strip(text: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def lines(text: Column) -> Column:
    """The lines of a text, none for an empty one; a line break at the end begins no line. Null stays null."""
    ended = F.regexp_replace(text, r"\R\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(ended, r"\R"))


def either(first: Column, second: Column) -> Column:
    """first, or second where first is empty or null (white space isn't empty)."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def first_line(text: Column, default: str = "ok") -> Column:
    """The first line of the stripped text, or the default."""
    return F.coalesce(F.get(lines(strip(text)), F.lit(0)), F.lit(default))


def joined_lines(text: Column, separator: str = " ") -> Column:
    """All lines of the stripped text on one line."""
    return F.array_join(lines(strip(text)), separator)


def outcome(out: Column, err: Column, code: Column) -> Column:
    """One line on a command: its first line of output, or on failure ``error: `` and all lines."""
    said = either(out, err)
    return F.when(code != 0, F.concat(F.lit("error: "), joined_lines(said))).otherwise(first_line(said))


def flat(out: Column, err: Column) -> Column:
    """The stripped output with `` | `` for line feeds, ``ok`` if there is none."""
    return either(F.replace(strip(either(out, err)), F.lit("\n"), F.lit(" | ")), F.lit("ok"))


def version(path: Column, code: Column, out: Column, err: Column) -> Column:
    """``missing`` without a program, its stripped output, or ``error: `` and what it wrote to the error stream."""
    return F.when(path.isNull(), F.lit(MISSING)).when(code != 0, F.concat(F.lit("error: "), strip(err))).otherwise(strip(out))


def tail(text: Column, count: int = 5, separator: str = " | ") -> Column:
    """The last lines of the stripped text, joined."""
    of = lines(strip(text))
    return F.array_join(F.slice(of, F.greatest(F.size(of) - (count - 1), F.lit(1)), F.lit(count)), separator)


def nonblank(text: Column) -> Column:
    """The lines that hold more than white space, as they are."""
    return F.filter(lines(text), lambda x: strip(x) != "")


def exit_text(code: Column) -> Column:
    """``exit=<code>``, or ``missing`` without a code."""
    return F.when(code.isNull(), F.lit(MISSING)).otherwise(F.concat(F.lit("exit="), code.cast("string")))


def named_code(code: Column, names: dict[int, str], default: str = "UNKNOWN") -> Column:
    """The name of a code, or the default."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def put_if_absent(map_: Column, key: str, value: str) -> Column:
    """The map with the key added where it has none; a present key keeps its value."""
    added = F.create_map(F.lit(key), F.lit(value))
    return F.when(F.map_contains_key(map_, F.lit(key)), map_).otherwise(F.map_concat(map_, added))


def search_path(parts: Column, old: Column) -> Column:
    """Folders joined by colons before the old path, with its colon even if the old path is empty."""
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ":"), F.lit(":"), F.coalesce(old, F.lit("")))).otherwise(old)


def instant(at: Column) -> Column:
    """A time as ISO text in UTC with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def requirement(text: Column) -> Column:
    """struct(package, extra, op, version) of a version specification like ``name[extra]>=1.2``."""
    pattern = r"^\s*([A-Za-z0-9._-]+)\s*(?:\[([^\]]*)\])?\s*(>=|==|<=|~=|!=|<|>|=)?\s*([^\s;#]*)"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("package"), part(2).alias("extra"), part(3).alias("op"), part(4).alias("version"))
