"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations.

A line goes if an earlier line (smaller document id, then line number) lies
within one edit of it, where an edit inserts, deletes or replaces one word.

1. Equal lines (lower-cased words) fall into one class with its earliest
   occurrence; partial aggregation takes the heat out of very common lines.
2. Two lines within one edit agree on their first or on their last half, so
   only classes that share a half with another class go on; the test loses
   nothing and spares most of a corpus the next step.
3. Each of those emits its variants as hashed keys: for every place the line
   without the word there, and the line itself at every place.  Lines within one
   edit share a key; a key's earliest line stands for it, so a key that very many
   lines share yields one row a line and never all pairs.
4. The earliest partner of each line is compared word by word (the verification
   of the distance), and the line's class is marked.

Defined results: blank lines stay; lines under ``min_fuzzy_words`` go only when
equal (from four words on an edit is at most a quarter of a line); lines under
``min_words`` stay, an option that is off at one word; null text has no lines; ids compare
as longs, a null id comes after all others; equal places (rows that share an id)
never remove each other; a document may lose all its lines and stays as a row
with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op8_line_dedup"
ORACLE_SQL = None

MIN_WORDS = 1
MIN_FUZZY_WORDS = 4
_LAST = 2 ** 63 - 1


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uneven(line: Column) -> Column:
    """Whether a line's words aren't simply parted by single spaces; plain searches
    for substrings take a quarter of the time of a regular expression."""
    found = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for part in ("  ", *common.BLANKS[1:]):
        found = found | F.contains(line, F.lit(part))
    return found


def normal_line(line: Column) -> Column:
    """The words of a lower-cased line with single spaces; most lines are so already."""
    return F.when(uneven(line), F.array_join(F.split(
        F.btrim(line, F.lit(common.BLANKS)), "[\\x20\\x09-\\x0D]+"), " ")).otherwise(line)


def line_words(normal: Column) -> Column:
    """Words of a normal line (a blank line gives one empty word)."""
    return F.split(normal, " ")


def identity(doc_id: str, text: str) -> tuple[Column, Column]:
    """(place of a row in the order, hash of its text): rows that share both are
    the same document."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), F.xxhash64(text)


def n_words(normal: Column) -> Column:
    """Size of :func:`line_words` without splitting the line."""
    return F.octet_length(normal) - F.octet_length(F.replace(normal, F.lit(" "), F.lit(""))) + 1


def half_keys(normal: Column, n: Column) -> Column:
    """Keys of the halves that a line of ``n`` words shares with lines within one edit:
    for a pair whose shorter line has ``m`` words, ``m // 2`` words at either end;
    first halves stand at even places.  They are cut from the normal form, as an array
    of words costs more than the rest of the line's work."""
    def keys(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit(side), m, F.call_function("substring_index", normal, F.lit(" "), h if side == "p" else -h))
                for side in "ps"]

    return F.array(*keys(n), *keys(n - 1))


def occurrences_of(docs: DataFrame, doc_id: str, text: str, min_words: int, min_fuzzy: int | None) -> DataFrame:
    """(id, text_key, line_no, h1, h2 and, with ``min_fuzzy``, halves) of every
    line of ``min_words`` words or more.  A line is known by two hashes of its normal
    form; its words are never split."""
    own, text_key = identity(doc_id, text)

    def entry(line: Column, k: Column) -> Column:
        def fields(x: Column) -> Column:
            cols = [k.alias("line_no"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")]
            if min_fuzzy is not None:
                cols.append(let(n_words(x), lambda n: F.when(n >= min_fuzzy, half_keys(x, n))).alias("halves"))
            enough = (x != "") if min_words <= 1 else (x != "") & (n_words(x) >= min_words)
            return F.when(enough, F.struct(*cols))

        return let(normal_line(line), fields)

    found = F.filter(F.transform(F.split(F.lower(text), "\n", -1), entry), lambda x: x.isNotNull())
    # a plain inline adds a filter that computes the array once more
    return docs.select(own.alias("id"), text_key.alias("text_key"), F.inline_outer(found)).where(F.col("h1").isNotNull())


def chain(words: Column, backwards: bool = False) -> Column:
    """Hashes of all prefixes (or, backwards, suffixes) of an array of words:
    element ``i`` covers ``i`` words from that end."""
    order = F.reverse(words) if backwards else words
    return F.aggregate(order, F.array(F.lit(0).cast("long")),
                       lambda acc, w: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), w))))


def variants(words: Column, prefix: Column, suffix: Column, only_keys: bool = False) -> Column:
    """(key, place, whole) of a line's variants, or their keys alone; ``prefix``/``suffix``:
    whether a shared half stands at that end, which the edit then does not touch."""
    n = F.size(words)
    half = F.floor((n - 1) / 2).cast("int")

    def at(i: Column) -> Column:
        return (prefix & (i >= half)) | (suffix & (i <= n - half))

    def entry(key: Column, place: Column, whole: bool) -> Column:
        return key if only_keys else F.struct(key.alias("key"), place.alias("place"), F.lit(whole).alias("whole"))

    def build(p: Column) -> Column:
        return let(chain(words, True), lambda s: F.concat(
            F.transform(F.filter(F.sequence(F.lit(0), n - 1), at), lambda i: entry(
                F.xxhash64(F.get(p, i), F.get(s, n - 1 - i), i, n - 1), i, False)),
            F.transform(F.filter(F.sequence(F.lit(0), n), at), lambda i: entry(
                F.xxhash64(F.get(p, i), F.get(s, n - i), i, n), i, True))))

    return let(chain(words), build)


def near_classes(classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(h1, h2) of classes whose earliest line has an earlier line within one
    edit."""
    keys = classes.where("halves IS NOT NULL").select("h1", "h2", "first", F.posexplode("halves").alias("k", "half"))
    shared = common.cut(keys.groupBy("half").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("half"))
    chosen = common.cut(keys.join(shared, "half").groupBy("h1", "h2", "first").agg(
        F.bool_or(F.col("k") % 2 == 0).alias("prefix"), F.bool_or(F.col("k") % 2 == 1).alias("suffix")))
    # Back to the words of each chosen class, at its earliest occurrence.
    wanted = chosen.groupBy(F.col("first.id").alias("id")).agg(F.collect_set("first.line_no").alias("nos"))
    own, _ = identity(doc_id, text)
    picked = (docs.select(own.alias("id"), F.col(text).alias("text")).join(wanted, "id")
              .select("id", let(F.split("text", "\n", -1), lambda ls: F.transform("nos", lambda k: F.struct(
                  k.alias("line_no"), F.get(ls, k).alias("line")))).alias("ls"))
              .select("id", F.explode("ls").alias("x")).where("x.line IS NOT NULL")
              .select(F.struct("id", "x.line_no").alias("first"), normal_line(F.lower("x.line")).alias("x"))
              .select("first", line_words(F.col("x")).alias("w"), F.xxhash64("x").alias("h1"),
                      F.xxhash64(F.lit(1), "x").alias("h2")))
    lines = common.cut(picked.join(chosen, ["h1", "h2", "first"]).dropDuplicates(["h1", "h2"]))
    emitted = lines.select("h1", "h2", "first", F.explode_outer(variants(F.col("w"), F.col("prefix"), F.col("suffix")))
                           .alias("v")).where(F.col("v").isNotNull()) \
        .select("h1", "h2", "first", "v.key", "v.place", "v.whole")
    # Most keys stand alone: count them first (two longs a row), so that only
    # shared keys are carried on with their lines.
    keys_only = lines.select(F.explode_outer(variants(F.col("w"), F.col("prefix"), F.col("suffix"), only_keys=True))
                             .alias("key")).where(F.col("key").isNotNull())
    shared = common.cut(keys_only.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"))
    meeting = common.cut(emitted.join(shared, "key"))
    earliest = common.cut(meeting.groupBy("key").agg(F.min(F.struct("first", "whole", "h1", "h2")).alias("e")))
    pairs = (meeting.join(earliest, "key").where(F.col("e.first") < F.col("first"))
             .groupBy("h1", "h2").agg(F.min(F.struct(
                 F.col("e.first").alias("first"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2"),
                 "place", "whole", F.col("e.whole").alias("other_whole"))).alias("p")))
    texts = lines.select("h1", "h2", "w")
    both = (pairs.join(texts, ["h1", "h2"]).select("h1", "h2", "w", "p")
            .join(texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("w").alias("o")),
                  (F.col("p.h1") == F.col("o1")) & (F.col("p.h2") == F.col("o2"))))
    return both.where(within_one_edit(F.col("w"), F.col("o"), F.col("p.place"), F.col("p.whole"),
                                      F.col("p.other_whole"))).select("h1", "h2")


def within_one_edit(a: Column, b: Column, place: Column, a_whole: Column, b_whole: Column) -> Column:
    """Verification: the two word sequences are equal but for the word at
    ``place`` (left out where a side is not whole)."""
    def rest(w: Column, whole: Column) -> Column:
        return F.when(whole, w).otherwise(F.concat(
            F.slice(w, F.lit(1), place), F.slice(w, place + 2, F.greatest(F.size(w) - place - 1, F.lit(0)))))

    return rest(a, a_whole) == rest(b, b_whole)


def duplicate_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                    min_fuzzy_words: int = MIN_FUZZY_WORDS) -> DataFrame:
    """(id, text_key, removed): the line numbers (from 0, ascending) that each
    document loses; documents that lose none have no row."""
    found = occurrences_of(docs, doc_id, text, min_words, min_fuzzy_words)
    classes = (found.groupBy("h1", "h2").agg(F.min(F.struct("id", "line_no")).alias("first"),
                                            F.count(F.lit(1)).alias("m"), F.first("halves").alias("halves")))
    classes = common.cut(classes)
    near = near_classes(classes, docs, doc_id, text).withColumn("near", F.lit(True))
    verdict = common.cut(classes.select("h1", "h2", "first", "m").join(near, ["h1", "h2"], "left")
                         .where("near OR m > 1").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")))
    # Splitting the lines again costs less than keeping all occurrences on disk.
    gone = occurrences_of(docs, doc_id, text, min_words, None).join(verdict, ["h1", "h2"]).where(
        F.col("near") | (F.struct("id", "line_no") > F.col("first")))
    return gone.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without their duplicate lines; same columns and rows."""
    gone = duplicate_lines(docs, doc_id=doc_id, text=text, **options)
    own, text_key = identity(doc_id, text)
    a, b, c = (common.fresh(docs, stem=x) for x in ("line_doc", "line_text_key", "line_gone"))
    gone = gone.select(F.col("id").alias(a), F.col("text_key").alias(b), F.col("removed").alias(c))
    kept = let(F.split(text, "\n", -1), lambda ls: F.array_join(F.transform(F.filter(
        F.sequence(F.lit(0), F.size(ls) - 1), lambda k: ~F.array_contains(F.col(c), k)),
        lambda k: F.get(ls, k)), "\n"))
    return (docs.withColumn(a, own).withColumn(b, text_key).join(gone, [a, b], "left")
            .withColumn(text, F.when(F.col(c).isNotNull(), kept).otherwise(F.col(text)))
            .select(*[f"`{x}`" for x in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    own, text_key = identity("doc_id", "text")
    every = docs.select("doc_id", own.alias("id"), text_key.alias("text_key"),
                        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    return every.join(duplicate_lines(docs), ["id", "text_key"], "left").select(
        "doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.array_join(F.coalesce("removed", F.array().cast("array<int>")), ","), 256).alias("removed_sha256"))
