"""Substring deduplication over sliding sentence spans.

A run is at least ``sentences`` consecutive sentences of ``min_words`` words, or
fewer sentences with ``long_words`` words.  The shortest run from each sentence
and the shortest one up to each sentence are hashed: whatever longer run is
repeated, its shortest ones are too, and together they cover it.  Equal runs meet in one grouping over the
corpus, which keeps for each repeated hash the earliest place (document id, then
sentence number); a join marks all other places, and the sentences that a marked
run covers are removed.

The grouping sums up inside each task first, and the join's small side holds only
repeated hashes, one row each, written to the checkpoint folder, so a passage
that a large share of all documents holds is split by Spark's skew handling.

Defined results: words are compared without case (A-Z) and punctuation; null
text has no sentences; a document too short for a run is one run if it has
``short_words`` words; ids compare as longs, a null id comes after all others;
rows that share an id never remove each other's sentences; of a document's own
repeats the first stays.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

common.by_value(sys.modules[__name__])

NAME = "op3_sentence_spans"
ORACLE_SQL = None

SENTENCES = 2
MIN_WORDS = 12
LONG_WORDS = 40
SHORT_WORDS = 8
_LAST = 2 ** 63 - 1
#: The end of a sentence: blanks after a full stop, or a line break.
END = re.compile(r"(?<=[.!?…])[ \t\r\f\v]+|[ \t\r\f\v]*\n\s*")
#: Bytes of a word; others become blanks.
WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
             for c in range(256))


def sentences_of(text: str | None) -> list[tuple[int, int]]:
    """Code point ranges of the sentences, each with the blanks behind it."""
    out, last = [], 0
    for m in END.finditer(text or ""):
        if m.end() > last:
            out.append((last, m.end()))
            last = m.end()
    if text and last < len(text):
        out.append((last, len(text)))
    return out


def runs_of(text: str | None, sentences: int, min_words: int, long_words: int,
            short_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentences, 16-byte hash) of the shortest runs."""
    words = [text[a:b].encode("utf-8", "surrogatepass").translate(WORD).split() for a, b in sentences_of(text)]
    filled = [k for k, w in enumerate(words) if w]
    n = len(filled)
    upto = [0, *accumulate(len(words[i]) for i in filled)]

    def enough(k: int, end: int) -> bool:
        total = upto[end] - upto[k]
        return total >= long_words or (end - k >= sentences and total >= min_words)

    ends: list[int] = []  # of the shortest run from each start that has one; never falling
    end = 0
    for k in range(n):
        end = max(end, k)
        while end < n and not enough(k, end):
            end += 1
        if not enough(k, end):
            break
        ends.append(end)
    runs = list(enumerate(ends))
    k = -1
    for end in range(1, n + 1):
        while k + 1 < len(ends) and ends[k + 1] <= end:
            k += 1
        if k >= 0 and ends[k] != end:
            runs.append((k, end))
    if filled and not runs and upto[n] >= short_words:
        runs.append((0, n))
    for k, end in runs:
        body = b"\n".join(b" ".join(words[i]) for i in filled[k:end])
        yield filled[k], filled[end - 1] - filled[k] + 1, hashlib.blake2b(body, digest_size=16).digest()


def identity(doc_id: str, text: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), F.xxhash64(text)


def spans(docs: DataFrame, doc_id: str, text: str, sizes: tuple) -> DataFrame:
    """(h1, h2, id, text_key, at, n) of every run of every document."""
    own, text_key = identity(doc_id, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h1, h2, ids, keys, at, n = ([] for _ in range(6))
            for key, text_key, text in zip(batch["id"], batch["text_key"], batch["text"]):
                for first, count, digest in runs_of(text, *sizes):
                    a, b = struct.unpack("<qq", digest)
                    h1.append(a)
                    h2.append(b)
                    ids.append(key)
                    keys.append(text_key)
                    at.append(first)
                    n.append(count)
                if len(h1) > 200_000:
                    yield pd.DataFrame({"h1": h1, "h2": h2, "id": ids, "text_key": keys, "at": at, "n": n})
                    h1, h2, ids, keys, at, n = ([] for _ in range(6))
            yield pd.DataFrame({"h1": h1, "h2": h2, "id": ids, "text_key": keys, "at": at, "n": n})

    return docs.select(own.alias("id"), text_key.alias("text_key"), F.col(text).alias("text")).mapInPandas(
        run, "h1 long, h2 long, id long, text_key long, at int, n int")


def repeated_sentences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentences: int = SENTENCES,
                       min_words: int = MIN_WORDS, long_words: int = LONG_WORDS,
                       short_words: int = SHORT_WORDS) -> DataFrame:
    """(id, text_key, removed): sentence numbers (from 0, ascending) covered by a
    run that occurs earlier; documents that lose none have no row."""
    every = spans(docs, doc_id, text, (sentences, min_words, long_words, short_words))
    place = F.struct("id", "at")
    firsts = common.cut(every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                        .where("first <> last").select("h1", "h2", "first"))
    later = every.join(firsts, ["h1", "h2"]).where(place > F.col("first")).select("id", "text_key", "at", "n").distinct()
    covered = later.select("id", "text_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("k"))
    return covered.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("k")).alias("removed"))


def dedup_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without the repeated sentences; same rows and columns."""
    gone = repeated_sentences(docs, doc_id=doc_id, text=text, **options)
    own, text_key = identity(doc_id, text)
    a, b, c = (common.fresh(docs, stem=x) for x in ("span_doc", "span_text_key", "span_gone"))
    gone = gone.select(F.col("id").alias(a), F.col("text_key").alias(b), F.col("removed").alias(c))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, lost: pd.Series) -> pd.Series:
        out = []
        for t, numbers in zip(texts, lost):
            if t is None or numbers is None:
                out.append(t)
            else:
                drop = set(numbers)
                out.append("".join(t[i:j] for k, (i, j) in enumerate(sentences_of(t)) if k not in drop))
        return pd.Series(out, dtype=object)

    joined = docs.withColumn(a, own).withColumn(b, text_key).join(gone, [a, b], "left")
    return joined.withColumn(text, rest(F.col(text), F.col(c))).select(*[f"`{x}`" for x in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    own, text_key = identity("doc_id", "text")
    every = docs.select("doc_id", own.alias("id"), text_key.alias("text_key"))
    return every.join(repeated_sentences(docs), ["id", "text_key"], "left").select(
        "doc_id", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.coalesce("removed", F.array().cast("array<int>")), ",").alias("removed_sentences"))
