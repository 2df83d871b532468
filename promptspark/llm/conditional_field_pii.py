"""Personal data: patterns plus a linear-chain conditional random field.

The base spans are plain patterns with checks.  A conditional random field over
word-shape features, trained on the driver from a small labelled table (at most
``MAX_LABELLED`` sentences, a few hundred weights' worth of counts), finds what
patterns miss: local phone numbers, spaced or obfuscated mail addresses,
identity numbers.  It is decoded by Viterbi in numpy batches of equally long
stretches.  A stretch is the text around a trigger (a digit, an ``@``, a
bracketed "at"); the field's tag elsewhere is ``O`` by definition, so most of a
corpus costs one pattern search and nothing else.  No shuffle: the weights are
broadcast (their number is bounded by the labelled table).

Defined results: null text is empty and has no spans; found spans that overlap a
base span are dropped, base spans never change; repeated rows are scanned one by
one; an empty labelled table gives a field that adds nothing.  Patterns run in
time linear in the text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

common.by_value(sys.modules[__name__])
common.by_value(common)

NAME = "op9_conditional_field_pii"
ORACLE_SQL = None

BASE_KINDS = ("email", "ip", "card", "phone")
#: The most sentences that training collects.
MAX_LABELLED = 5000
#: Characters on both sides of a trigger that belong to its stretch.
REACH = 60
#: Tokens that are decoded at once.
BATCH_TOKENS = 200_000

#: The labelled table, ``{kind|text}`` marks a span.
LABELLED = """
please call {number|(377) 555-0271} after nine
call {number|555 0199} today or mail me
phone : {number|020 7946 0018} ask for the office
tel . {number|0171 5550 143} between eight and ten
my number is {number|301-555-0148} thanks
fax {number|(212) 555-0190} or post
reach her at {number|555-0123} any time
mobile {number|07700 900123} or the desk
ring {number|030 23125 014} in the morning
telephone {number|(020) 7946 0321} , extension 12
contact {number|415.555.0132} for details
sms to {number|0151 555 0177} please
write to {mail|jane.doe (at) example (dot) com} now
mail {mail|john [at] example [dot] org} for a copy
send it to {mail|info {at} example {dot} net} please
ask {mail|mary (at) mail.example.com} about it
address {mail|smith @ example . com} is best
reply to {mail|peter @ example.org} soon
or {mail|anna (at) example . net} instead
his mail {mail|max [at] example.com} was wrong
ssn {ident|123-45-6789} on file
social security number {ident|987-65-4320} was leaked
the id is {ident|078-05-1120} , she said
ssn : {ident|219-09-9999} end
iban {ident|DE89 3704 0044 0532 0130 00} for the rent
account {ident|GB29 NWBK 6016 1331 9268 19} was closed
pay to {ident|FR14 2004 1010 0505 0001 3M02 606} by friday
iban : {ident|ES91 2100 0418 4502 0005 1332} thanks
in 1998 the town had 24,500 people
version 3.13.2 came out on 2024-10-07
the price rose from 12.50 to 13.75 in 2021
pages 101 - 145 and 210 - 219 are missing
room 305 , floor 3 , building 12
token = " 49ab8b03847754d938118ecf003181de2dc09b88 "
they sold 1,200,000 units in 2019 and 2020
see section 4.2.1 and table 17
at 10:30 on 12 / 05 / 2020 we left
the score was 3 - 2 after 90 minutes
x = 5 + 7 * ( 12 - 4 )
error 404 at line 1024 of 2048
isbn 978-3-16-148410-0 is out of print
order 4711 has 12 items at 99 cents
between 1939 - 1945 and 1950 - 1953
a ratio of 16 : 9 or 4 : 3
12345 steps in 30 days
hash 5d41402abc4b2a76b9719d911017c592 of the file
he scored 100 ( 50 % ) of 200 points
chapter 12 , verse 7 - 9
add 250 g of flour , 2 eggs and 100 ml of milk
mail @ 5 pm or come @ 6
follow @ user42 and @ team7 there
between 10 - 20 and 30 - 40 percent
the code 8066 was used in 2003
from 192 to 255 by 8
in the years 2001 2002 2003 and 2004
batch 000123 of 004567 is done
2390409500648960 atatble , eredthou
the 6375986702482655 the atstst the that
+ 1 + 2 + 3 + 4 = 10
lot 12-34 and lot 56-78
TOKEN = " 5D41402ABC4B2A76B9719D911017C592 " END
KEY : 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B
digest E3B0C44298FC1C149AFBF4C8996FB924 of the file
""".strip().splitlines()

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s\w]|[\w]")
MARK = re.compile(r"\{(number|mail|ident)\|((?:[^{}]|\{at\}|\{dot\})*)\}")
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]")

IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the mail pattern: the run of local characters before an ``@``
    (not before the previous match's end), then a domain with a dot."""
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), kind by kind as listed, each by start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# -- the field ---------------------------------------------------------------

KINDS = ("number", "mail", "ident")
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]


def features(token: str) -> list[str]:
    """Word-shape features of one token."""
    if token.isdigit():
        return ["digits", f"d{min(len(token), 9)}"]
    if token.isalpha():
        low = token.lower()
        out = ["word", f"w{min(len(token), 6)}", "upper" if token.isupper() else "title" if token.istitle() else "lower"]
        return out + ([f"is {low}"] if len(low) <= 10 and token.isascii() else [])
    return ["sign", f"is {token}"]


class Field:
    """Weights of a linear-chain conditional random field: features of a token,
    of its predecessor and of its successor, and tag transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.known: dict[str, np.ndarray] = {}

    def scores(self, token: str) -> np.ndarray:
        """(3, tags): what a token adds to its successor, itself, its predecessor."""
        have = self.known.get(token)
        if have is None:
            if len(self.known) > 50_000:
                self.known.clear()
            rows = [self.names[f] for f in features(token) if f in self.names]
            have = self.known[token] = self.weights[:, rows].sum(axis=1)
        return have

    def emissions(self, sequences: list[list[str]]) -> np.ndarray:
        """(sequences, length, tags) of equally long sequences."""
        s = np.array([[self.scores(t) for t in seq] for seq in sequences])
        out = s[:, :, 1].copy()
        out[:, 1:] += s[:, :-1, 0]
        out[:, :-1] += s[:, 1:, 2]
        return out

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Best tags of each sequence (Viterbi over batches of one length)."""
        by_length: dict[int, list[int]] = {}
        for k, seq in enumerate(sequences):
            by_length.setdefault(len(seq), []).append(k)
        out: list = [None] * len(sequences)
        for length, rows in by_length.items():
            step = max(1, BATCH_TOKENS // max(length, 1))
            for lo in range(0, len(rows), step):
                part = rows[lo:lo + step]
                for k, tags in zip(part, self.viterbi(self.emissions([sequences[k] for k in part]))):
                    out[k] = tags
        return out

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        n, length, _ = e.shape
        best = e[:, 0].copy()
        back = np.zeros((n, length, e.shape[2]), dtype=np.int8)
        for t in range(1, length):
            to = best[:, :, None] + self.moves[None]
            back[:, t] = to.argmax(axis=1)
            best = to.max(axis=1) + e[:, t]
        tags = np.zeros((n, length), dtype=np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags


def parse(sentence: str) -> tuple[list[str], list[int]]:
    """Tokens and tag numbers of a marked sentence."""
    tokens, tags, last = [], [], 0
    for m in MARK.finditer(sentence):
        before = TOKEN.findall(sentence[last:m.start()])
        inside = TOKEN.findall(m.group(2))
        b = TAGS.index(f"B-{m.group(1)}")
        tokens += before + inside
        tags += [0] * len(before) + [b] + [b + 1] * (len(inside) - 1)
        last = m.end()
    rest = TOKEN.findall(sentence[last:])
    return tokens + rest, tags + [0] * len(rest)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(sentences: list[str], steps: int = 150, rate: float = 0.15, decay: float = 0.002) -> Field:
    """Maximum likelihood with weight decay: forward-backward over padded
    batches, Adam steps.  Deterministic."""
    data = [(x, y) for x, y in map(parse, sentences) if x]
    names: dict[str, int] = {}
    for x, _ in data:
        for t in x:
            for f in features(t):
                names.setdefault(f, len(names))
    k = len(TAGS)
    params = np.zeros(3 * len(names) * k + k * k)
    if not data:
        return Field(names, np.zeros((3, 0, k)), np.zeros((k, k)))
    n, length = len(data), max(len(x) for x, _ in data)
    active = np.zeros((n, length + 2, len(names)))
    gold, live = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (x, y) in enumerate(data):
        live[i, :len(x)] = True
        gold[i, :len(y)] = y
        for t, token in enumerate(x):
            active[i, t + 1, [names[f] for f in features(token)]] = 1
    views = np.stack([active[:, :-2], active[:, 1:-1], active[:, 2:]])  # before, at, after
    target = np.eye(k)[gold] * live[:, :, None]
    pairs = live[:, 1:]
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, moves = params[:-k * k].reshape(3, len(names), k), params[-k * k:].reshape(k, k)
        e = np.einsum("vntf,vfk->ntk", views, w)
        fwd, bwd = np.zeros((n, length, k)), np.zeros((n, length, k))
        fwd[:, 0] = e[:, 0]
        for t in range(1, length):
            nxt = _log_sum(fwd[:, t - 1][:, :, None] + moves[None], 1) + e[:, t]
            fwd[:, t] = np.where(live[:, t][:, None], nxt, fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            prev = _log_sum(moves[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(live[:, t + 1][:, None], prev, bwd[:, t + 1])
        z = _log_sum(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
        edge = np.exp(fwd[:, :-1, :, None] + moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :]
                      - z[:, None, None, None]) * pairs[:, :, None, None]
        g_w = np.einsum("vntf,ntk->vfk", views, target - node)
        g_m = np.einsum("nti,ntj->ij", target[:, :-1] * pairs[:, :, None], target[:, 1:]) - edge.sum(axis=(0, 1))
        g = np.r_[g_w.ravel(), g_m.ravel()] / n - decay * params
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        params = params + rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return Field(names, params[:-k * k].reshape(3, len(names), k), params[-k * k:].reshape(k, k))


def stretches(text: str) -> list[tuple[int, int]]:
    """Character ranges around the triggers, cut at blanks, unioned."""
    out: list[list[int]] = []
    end = 0
    m = TRIGGER.search(text)
    while m:
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
        end = m.end()
        m = TRIGGER.search(text, end)
    for r in out:
        if r[0]:
            cut = text.find(" ", r[0], r[1])
            r[0] = cut + 1 if 0 <= cut < r[0] + REACH // 2 else r[0]
        if r[1] < len(text):
            cut = text.rfind(" ", r[0], r[1])
            r[1] = cut if cut > r[1] - REACH // 2 else r[1]
    return [(a, b) for a, b in out if a < b]


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field tags, of each text, with at least six digits or a
    sign of a mail address."""
    where, sequences = [], []
    for k, text in enumerate(texts):
        for a, b in stretches(text):
            found = list(TOKEN.finditer(text, a, b))
            if found:
                where.append((k, found))
                sequences.append([m.group() for m in found])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (k, found), tags in zip(where, field.decode(sequences) if field.names else []):
        t = 0
        while t < len(tags):
            tag = int(tags[t])
            if tag and (tag - 1) % 2 == 0:
                e = t + 1
                while e < len(tags) and tags[e] == tag + 1:
                    e += 1
                piece = "".join(m.group() for m in found[t:e])
                kind = KINDS[(tag - 1) // 2]
                enough = (re.search(r"@|[(\[{]at[)\]}]", piece) if kind == "mail"
                          else sum(c.isdigit() for c in piece) >= 6)
                if enough:
                    out[k].append((kind, found[t].start(), found[e - 1].end()))
                t = e
            else:
                t += 1
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """The built-in labelled sentences as a table (sentence string)."""
    return spark.createDataFrame([(s,) for s in LABELLED], "sentence string")


def personal_data(docs: DataFrame, labelled: DataFrame, *, text: str = "text", out: str = "pii") -> DataFrame:
    """Every row with ``out`` (which replaces a column of that name): array of (kind, start, end, base), offsets in code
    points, base kinds first as listed, then the field's, each by start."""
    spark = docs.sparkSession
    rows = labelled.select("sentence").where("sentence IS NOT NULL").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled sentences")
    field = spark.sparkContext.broadcast(train(sorted(r["sentence"] for r in rows)))

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Field(field.value.names, field.value.weights, field.value.moves)
        for batch in batches:
            texts = [t or "" for t in batch]
            found = []
            for text, more in zip(texts, field_spans(texts, f)):
                base = base_spans(text)
                taken = sorted((a, b) for _, a, b in base)
                extra = [(kind, a, b) for kind, a, b in more if not any(a < d and c < b for c, d in taken)]
                found.append([{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base]
                           + [{"kind": k, "start": a, "end": b, "base": False}
                              for k, a, b in sorted(extra, key=lambda s: (KINDS.index(s[0]), s[1]))])
            yield pd.Series(found)

    return docs.drop(*[c for c in docs.columns if c.lower() == out.lower() and c != text]).withColumn(
        out, find.asNondeterministic()(F.col(text)))


def redact(docs: DataFrame, labelled: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; same
    columns.  Of overlapping spans the one that starts first is replaced."""
    spans = common.fresh(docs, stem="pii")
    marked = personal_data(docs, labelled, text=text, out=spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    body = F.aggregate(ordered, zero, lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")),
                 F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1,
                                                     F.char_length(F.col(text)))))
    return marked.withColumn(text, F.when(F.size(spans) > 0, body).otherwise(F.col(text))).select(
        *[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    found = personal_data(docs, labelled_table(spark))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("pii", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE_KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
