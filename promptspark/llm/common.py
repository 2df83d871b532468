"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"


def by_value(module) -> None:
    """Ship a module's functions inside the task closure, so that executors
    need no copy of this package."""
    cloudpickle.register_pickle_by_value(module)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table by Spark's reader; ``columns`` prune the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(c) -> Column:
    """Lower-case A-Z only."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(c="text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def blank_words(c) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: none)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_extract_all(c, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)),
                      F.array().cast("array<string>"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (a fresh one only in a
    local session without that setting)."""
    from promptspark.session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(*frames: DataFrame, stem: str) -> str:
    """A column name that none of the frames uses."""
    used = {c.lower() for f in frames for c in f.columns}
    name, k = stem, 0
    while name.lower() in used:
        k += 1
        name = f"{stem}{k}"
    return name


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed odd multipliers, wrap-around)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Odd base of the polynomial word hash.
_BASE = np.uint64(0x5851F42D4C957F2D)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the blank-separated words of all texts behind each other,
    and the index where each text's words begin (and the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    if len(starts) == 0:
        return np.empty(0, np.uint64), bounds
    length = ends - starts
    letters = np.flatnonzero(~blank)
    first = np.r_[0, np.cumsum(length)[:-1]]
    place = np.arange(len(letters)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
    return mix(np.add.reduceat((data[letters].astype(np.uint64) + np.uint64(1)) * power[place], first)
               + length.astype(np.uint64)), bounds


#: Bytes of text that are hashed in one pass.
CHUNK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def chunked_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` in passes of bounded size; long texts are cut at blanks."""
    counts = np.zeros(len(texts), dtype=np.int64)
    out: list[np.ndarray] = []
    held: list[bytes] = []
    owner: list[int] = []
    weight = 0

    def flush():
        nonlocal held, owner, weight
        if held:
            words, bounds = word_hashes(held)
            out.append(words)
            np.add.at(counts, np.array(owner), np.diff(bounds))
        held, owner, weight = [], [], 0

    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            m = _BLANK.search(t, at + CHUNK) if len(t) - at > CHUNK else None
            end = m.start() if m else len(t)
            held.append(t[at:end])
            owner.append(k)
            weight += end - at
            at = end
            if weight >= CHUNK:
                flush()
    flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.r_[0, np.cumsum(counts)]


def lowered(texts: list[str | None]) -> list[bytes]:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]


def total_bytes(df: DataFrame, c: str = "text") -> int:
    """UTF-8 bytes of a column over the whole table (one narrow aggregate)."""
    return int(df.agg(F.sum(F.octet_length(c))).first()[0] or 0)
