"""String normalisers and splitters as Catalyst expressions.

Unicode semantics: the reference trims/splits on the Unicode White_Space set,
so every regex here uses Java's ``(?U)`` flag (plain ``\\s`` misses U+00A0).
Lengths: ``chars`` = code points (``char_length``), ``bytes`` = UTF-8 octets
(``octet_length``); each operator states which one it follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Higher-order functions run interpreted and Catalyst neither shares
    subexpressions inside lambdas nor accounts for lambda multiplicity when it
    collapses projections, so an array expression read from inside another
    lambda would be recomputed per element.  Binding it through a one-element
    ``transform`` computes it exactly once per row."""
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def utrim(c) -> Column:
    """Unicode-aware trim (Spark's ``trim`` strips only ASCII blanks)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def lines(c) -> Column:
    """Split into lines like ``str::lines``: ``\\n`` or ``\\r\\n``, and one
    trailing empty line (after a final newline) dropped."""
    return let(F.split(col(c), r"\r?\n"), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def words(c) -> Column:
    """Whitespace-separated words (``split_whitespace``); empty text -> []."""
    return let(utrim(c), lambda t: F.when(t == "", F.array().cast("array<string>"))
               .otherwise(F.split(t, WS + "+")))


def word_count(c) -> Column:
    return F.size(words(c))


def normalize_content(c) -> Column:
    """Duplicate-detection normal form: trim every line, drop empty lines,
    join with ``\\n``, lower-case."""
    trimmed = F.transform(F.split(col(c), "\n"), lambda l: utrim(l))
    return F.lower(F.array_join(F.filter(trimmed, lambda l: l != ""), "\n"))


def normalize_text(c) -> Column:
    """Similarity normal form: lower-case, whitespace runs -> one space, trim."""
    return F.lower(utrim(F.regexp_replace(col(c), WS + "+", " ")))


def ascii_only(c) -> Column:
    return col(c).rlike(r"^[\x00-\x7F]*$")


def char_width(c) -> Column:
    """Bytes of a text's widest UTF-8 character (1-4)."""
    return (F.when(col(c).rlike("[\\x{10000}-\\x{10FFFF}]"), 4).when(col(c).rlike("[\\x{800}-\\x{FFFF}]"), 3)
            .when(col(c).rlike("[^\\x00-\\x7F]"), 2).otherwise(1))
