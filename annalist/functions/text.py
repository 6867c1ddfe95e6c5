"""Text columns: log entries, fenced blocks, headers, ids and clean-up expressions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F

# The line that opens an entry, fenced blocks, headers, the level used when none is given.
OPENER = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} \| .+ \|"
FENCED = r"(?s)```(.*?)```|~~~(.*?)~~~"
HEADER = r"(?d)\*\*\*(.*?)\*\*\*"
DEFAULT_LEVEL = "EVENT"
ID_PREFIX = "mon"
# Every character a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends (Spark's ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_opener(line: Column) -> Column:
    return line.rlike("(?d)" + OPENER)


def fenced_blocks(text: Column, tag: str = "json") -> Column:
    """Bodies of all fenced blocks, without the fences and a leading ``tag``.

    A block with another tag is returned with that tag still in front.
    """
    matches = F.transform(
        F.regexp_extract_all(text, F.lit(FENCED), F.lit(0)),
        lambda b: F.substr(b, F.lit(4), F.length(b) - 6),
    )
    # With one kind of fence only, the bodies are every second piece between fences.
    pieces = F.split(text, "```")
    closed = F.filter(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda _, i: i % 2 == 0
    )
    bodies = (
        F.when(text.contains("~~~"), matches)
        .when(text.contains("```"), closed)
        .otherwise(F.array().cast("array<string>"))
    )
    return F.transform(
        bodies, lambda b: F.when(F.startswith(b, F.lit(tag)), F.substr(b, F.lit(len(tag) + 1))).otherwise(b)
    )


def header(text: Column, default: Column | None = None) -> Column:
    """The first ``***name***`` on one line, else ``default``."""
    found = F.when(text.rlike(HEADER), F.regexp_extract(text, HEADER, 1))
    return found if default is None else F.coalesce(found, default)


def short_id(text: Column, size: int = 16, prefix: str = ID_PREFIX) -> Column:
    """Prefix plus ``2 * size`` upper-case hex digits of the SHA-256 of the text."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(text, 256), 1, 2 * size)))


def shake_id(size: int = 5, prefix: str = ID_PREFIX):
    """A column function giving SHAKE-256 ids, for stores whose ids must stay the same.

    Five bytes collide from about a million rows on; ``short_id`` is the default.
    """

    @F.pandas_udf("string")
    def _shake(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda s: None
            if s is None
            else prefix + hashlib.shake_256(s.encode()).hexdigest(size).upper()
        )

    return _shake


def entry_id(date: Column, level: Column, process: Column, *more: Column) -> Column:
    """Id of an entry from its preamble; pass the content too to tell equal preambles apart."""
    return F.sha2(F.concat_ws("|", date, level, process, *more), 256)


def key_hash(*keys: str, seed: int = 0) -> Column:
    """A 32-bit number that looks random but depends only on the keys and the seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


# Clean-up expressions used when preparing tables.


def number(text: Column) -> Column:
    """``"12%"`` gives 12.0 and ``"2,243"`` gives 2243.0; anything else unreadable is null."""
    return F.regexp_replace(text, "[%,]", "").try_cast("double")


def sentinel(text: Column, marker: str = "-", value: str = "-1") -> Column:
    return F.when(text == marker, F.lit(value)).otherwise(text)


def first_of_list_literal(text: Column) -> Column:
    """First item of a list written as ``"['a', 'b']"``."""
    return F.get(F.from_json(text, "array<string>", {"allowSingleQuotes": "true"}), F.lit(0))


def as_list(text: Column) -> Column:
    """JSON list text to an array, null when it is no list."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def code_label(code: Column, labels: list[str], unknown: str = "Unknown") -> Column:
    """Label of a code counted from 1."""
    return F.coalesce(
        F.get(F.array(*[F.lit(x) for x in labels]), (code - 1).cast("int")), F.lit(unknown)
    )


def without(text: Column, marker: str) -> Column:
    return F.replace(text, F.lit(marker), F.lit(""))


def before(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, 1)


def plain_title(text: Column) -> Column:
    """Keep ASCII letters, digits and whitespace."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9\s]", "")


def every_nth(items: Column, step: int = 10, limit: int = 10) -> Column:
    return F.slice(F.filter(items, lambda x, i: i % step == 0), 1, limit)


def snake_names(columns: list[str]) -> list[str]:
    """Snake-case column names, ``/`` and ``__`` become ``_``."""
    import re

    out = []
    for c in columns:
        c = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c)
        c = re.sub(r"[\s\-./]", "_", c).lower()
        out.append(re.sub(r"_+", "_", c))
    return out
