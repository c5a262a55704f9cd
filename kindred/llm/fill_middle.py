"""Fill-in-the-middle documents by escaped marker injection, in SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units that a document is cut into: regular expressions that cover every text and keep an escaped pair together.
LINES, WORDS, CHARACTERS = r"[^\n]*+\n|[^\n]++", r"\S*+\s++|\S++", r"(?s)\x01.|."

#: The delimiter that is put after each unit, and the character that escapes both in texts.
MARK, ESCAPE = "\u0002", "\u0001"


@dataclass(frozen=True)
class Markers:
    """Strings before the prefix, the suffix and the middle.  A text that holds one of them is left as it is."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if len(set(self.all)) < 3 or any(len(m) < 2 or m[0] in m[1:] for m in self.all):
            raise ValueError("markers are three different strings whose first character comes only once")
        if any(a != b and a in b for a in self.all for b in self.all):
            raise ValueError("no marker may be part of another")
        if len({m[0] for m in self.all}) > 1:
            raise ValueError("markers begin with the same character")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _no_marks(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(""))


def marked(text: Column, unit: str = LINES) -> Column:
    """The text with the delimiter after every unit; delimiters of its own are escaped."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "a")), F.lit(MARK), F.lit(ESCAPE + "b"))
    return F.regexp_replace(escaped, unit, "$0" + MARK)


def count_units(marks: Column) -> Column:
    """Number of units of a marked text."""
    return F.length(marks) - F.length(_no_marks(marks))


def _part(marks: Column) -> Column:
    """Plain text of a part of a marked text."""
    return F.replace(F.replace(_no_marks(marks), F.lit(ESCAPE + "b"), F.lit(MARK)), F.lit(ESCAPE + "a"), F.lit(ESCAPE))


def _index(marks: Column, count: Column) -> Column:
    return F.call_function("substring_index", marks, F.lit(MARK), count)


def first_units(marks: Column, n: Column) -> Column:
    """Text of the first n units of a marked text."""
    return _part(_index(marks, n))


def units_between(marks: Column, start: Column, end: Column) -> Column:
    """Text of the units from ``start`` (not included) to ``end`` (included), counted from 1."""
    return _part(_index(_index(marks, end), start - end))


def units_after(marks: Column, n: Column, units: Column) -> Column:
    """Text of what follows the first n of ``units`` units."""
    return _part(_index(marks, n - units - 1))


def seed_words(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of ``<seed>:<key>``; a null key is hashed as no characters."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, rate: int = 100, suffix_first: int = 50, seed: int = 7,
    markers: Markers = Markers(),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix, middle, suffix, output``.

    A text is cut into ``n`` units.  The hash of seed and id gives h1 to h4: the prefix ends after the smaller of h1 and h2 modulo
    n + 1 units, the middle after the larger, the suffix is the rest.  ``rate`` percent of documents (by h3) are transformed, of
    those ``suffix_first`` percent (by h4) in the form ``spm``: suffix, prefix, middle; the others as ``psm``: prefix, suffix, middle.
    A text that is empty or null, or holds a marker, is ``plain``: the output is the text, and the parts are null.

    Delimiters inside texts are escaped, so every text comes back whole (``restored``), however long.  Rows that repeat an id are cut
    by the same numbers, each by its own units; a null id hashes as no characters.  An empty table gives an empty result; only the id
    and the text are read, so no name can clash.  Nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("marks", marked(F.col("text"), unit))
    rows = rows.withColumn("n", count_units(F.col("marks"))).withColumn("h", F.array(*seed_words(F.col("doc_id"), seed)))
    at = [F.pmod(F.col("h")[i], F.col("n") + 1).cast("int") for i in (0, 1)]
    held = F.lit(False)
    for m in markers.all:
        held = held | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | held | (F.pmod(F.col("h")[2], F.lit(100)) >= rate), "plain").when(
        F.pmod(F.col("h")[3], F.lit(100)) < suffix_first, "spm"
    ).otherwise("psm")
    rows = rows.select("doc_id", "text", "marks", "n", F.least(*at).alias("i"), F.greatest(*at).alias("j"), form.alias("form"))
    cut: Callable[[Column], Column] = lambda c: F.when(F.col("form") != "plain", c)
    parts = rows.select(
        "doc_id", "text", "n", "form", cut(first_units(F.col("marks"), F.col("i"))).alias("prefix"),
        cut(units_between(F.col("marks"), F.col("i"), F.col("j"))).alias("middle"),
        cut(units_after(F.col("marks"), F.col("j"), F.col("n"))).alias("suffix"),
    )
    prefix, suffix, middle = (F.concat(F.lit(m), p) for m, p in zip(markers.all, ("prefix", "suffix", "middle"), strict=True))
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
    return parts.select("doc_id", F.col("n").cast("long").alias("n"), "form", "prefix", "middle", "suffix", F.coalesce(output, "text").alias("output"))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that an output was made of.

    No marker begins inside another or inside a part, so each comes once, and what is between them are the parts."""
    index = lambda s, m, n: F.substring_index(s, m, n)
    middle, head = index(output, markers.middle, -1), index(output, markers.middle, 1)
    psm = F.concat(index(index(head, markers.suffix, 1), markers.prefix, -1), middle, index(head, markers.suffix, -1))
    spm = F.concat(index(head, markers.prefix, -1), middle, index(index(head, markers.prefix, 1), markers.suffix, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
