"""Secret scans with multipart credential linking, in column expressions.

Strong findings (base kinds) are pattern matches with offsets, computed inside
the row: splitting a text at a pattern gives the pieces between its matches,
extracting it gives the matches, and running lengths give the offsets.

Weak candidates say little alone: a word that looks like an access identifier, a
long random-looking secret, an endpoint.  They are reported only where
complementary parts stand together.  Distinct texts with at least two different
kinds of parts are exploded to one row per part and joined with themselves on
(text, bucket of offsets) under an interval condition: parts of different kinds
whose distance is at most ``SCOPE`` code points and that no blank line
separates.  A left-semi join reports a part once, however many partners it has,
so no pairs are written; a bucket is ``SCOPE`` code points wide, so neither a
long text nor a text with many copies (one row per distinct text) makes a hot
key.

Defined results: null text is empty; offsets are code points, ends exclusive;
base spans never change; a weak part that overlaps a base span is not reported
again, but the base span counts as its partner; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op4_credential_links"
ORACLE_SQL = None

#: Pattern, and least length of the tested group, of the base kinds.
ASSIGN = "((?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
ACCESS = "(AKIA[A-Z0-9]+)"
HEX = "([0-9a-f]{32,})"
BASE = ("assign", "access", "hex")
#: Weak parts: an identifier, a secret and an endpoint; patterns with whole-match
#: group 1.  Words are bounded by what may not continue them.
WEAK = {
    "identifier": "(?<![A-Za-z0-9_])([A-Za-z0-9_]*(?i:(?:access|client|account|user|key)_?(?:key_?)?id)[\"']?\\x20*[:=]\\x20*[\"']?"
                  "[A-Za-z0-9_.@-]{4,64})",
    "key": "(?<![A-Za-z0-9+/=_-])((?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/=_-])",
    "endpoint": "((?i:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.:@/_%-]{4,256})",
}
#: What each base kind is for its neighbours.
ROLE = {"assign": "key", "access": "identifier", "hex": "key"}
#: Least length of a secret inside an identifier or endpoint, whose own words
#: and paths are often 20 characters long.
INNER = 40
SCOPE = 300

_SPAN = "array<struct<start:bigint,end:bigint>>"


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, group: int, least: int, tested: int | None = None) -> Column:
    """(start, end) of the non-overlapping matches of ``pattern``, which must be
    covered by its groups 1 to ``group``, where group ``tested`` has at least
    ``least`` characters.  One search per text that has no match."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    part = whole if tested is None else F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(tested + 1))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.zip_with(whole, part, lambda w, p: F.struct(F.char_length(w).alias("w"),
                                                                     F.char_length(p).alias("p"))),
                         F.transform(gaps, lambda g: F.char_length(g)),
                         lambda m, g: F.struct(g.alias("g"), m["w"].alias("w"), m["p"].alias("p")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        a = acc["at"] + m["g"]
        b = a + F.coalesce(m["w"], F.lit(0))
        return F.struct(b.cast("long").alias("at"), F.when(m["p"] >= least, F.concat(acc["out"], F.array(
            F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(lengths, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def tagged(kind: str, found: Column, base: bool) -> Column:
    rank = [*BASE, *WEAK].index(kind)
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"),
        F.lit(base).alias("base")))


def base_spans(text: Column) -> Column:
    """The base spans, by start, then kind as listed."""
    return F.array_sort(F.concat(tagged("assign", spans(text, ASSIGN, 2, 8, tested=2), True),
                                 tagged("access", spans(text, ACCESS, 1, 16), True),
                                 tagged("hex", spans(text, HEX, 1, 32), True)))


def weak_spans(text: Column) -> Column:
    """Weak parts; a short secret inside another weak part belongs to that part."""
    found = {kind: tagged(kind, spans(text, pattern, 1, 1), False) for kind, pattern in WEAK.items()}

    def standing(around: Column) -> Column:
        keys = F.filter(found["key"], lambda s: (s["end"] - s["start"] >= INNER) | ~F.exists(
            around, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
        return F.concat(keys, around)

    return let(F.concat(found["identifier"], found["endpoint"]), standing)


def linked_parts(parts: DataFrame, scope: int) -> DataFrame:
    """(text_key, part) of the weak parts with a complementary part in scope;
    ``parts`` is (text_key, part, role, paragraph)."""
    left = parts.where("NOT part.base").withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("part.start") / scope), F.floor(F.col("part.end") / scope))))
    right = parts.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("part.start") / scope) - 1, F.floor(F.col("part.end") / scope) + 1)))
    x, y = left.alias("x"), right.alias("y")
    near = ((F.col("x.text_key") == F.col("y.text_key")) & (F.col("x.bucket") == F.col("y.bucket"))
            & (F.col("x.paragraph") == F.col("y.paragraph")) & (F.col("x.role") != F.col("y.role"))
            & (F.col("x.part.start") <= F.col("y.part.end") + scope)
            & (F.col("y.part.start") <= F.col("x.part.end") + scope))
    return x.join(y, near, "left_semi").select("text_key", "part").distinct()


def scan(docs: DataFrame, *, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Every row with ``secrets``: array of (start, rank, kind, end, base) by
    start, then kind; base kinds and linked weak kinds."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "secrets" and c != text])
    t = F.coalesce(F.col(text), F.lit(""))
    base, key, weak = (common.fresh(docs, stem=x) for x in ("base_spans", "text_key", "linked_spans"))
    # Texts that hold a weak part at all are few; only they are hashed and joined.
    marked = docs.withColumn(base, base_spans(t))
    slim = docs.select(t.alias("text")).where(F.col("text").rlike("|".join(WEAK.values())))
    c = F.col("text")
    everything = slim.select(F.sha2(c, 256).alias("text_key"), c, F.concat(
        base_spans(c), weak_spans(c)).alias("parts"))
    several = everything.where(F.size(F.array_distinct(F.transform("parts", lambda s: role(s["kind"])))) > 1)
    rows = (several.dropDuplicates(["text_key"]).select("text_key", "text", F.explode("parts").alias("part")).select(
        "text_key", "part", role(F.col("part.kind")).alias("role"), paragraph("text", F.col("part.start")).alias("paragraph")))
    found = linked_parts(rows, scope).groupBy("text_key").agg(F.collect_set("part").alias("found"))
    found = common.cut(found.select(F.col("text_key").alias(key), F.col("found").alias(weak)))
    # Texts without a weak part get a key of their own, which spreads them and joins nothing.
    out = marked.withColumn(key, F.when(t.rlike("|".join(WEAK.values())), F.sha2(t, 256)).otherwise(
        F.concat(F.lit("-"), F.monotonically_increasing_id())))
    out = out.join(found, key, "left")
    extra = F.filter(F.coalesce(F.col(weak), F.array()), lambda s: ~F.exists(
        F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("secrets", F.array_sort(F.concat(F.col(base), extra))).select(
        *[f"`{c}`" for c in docs.columns], "secrets")


def role(kind: Column) -> Column:
    out = kind
    for base, r in ROLE.items():
        out = F.when(kind == base, F.lit(r)).otherwise(out)
    return out


def paragraph(text: str, start: Column) -> Column:
    """Number of blank lines before an offset."""
    return F.size(F.split(F.substring(F.col(text), F.lit(1), start.cast("int")), "\\n[ \\t\\r]*\\n", -1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    found = scan(docs)

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("secrets", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))
