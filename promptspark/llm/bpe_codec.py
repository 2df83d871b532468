"""BPE encoding and decoding with batched numpy merge rounds.

The vocabulary file (a public ``tokenizers`` JSON: BPE with a word-end suffix
over byte-level characters) is read once on the driver, turned into flat arrays
of bounded size and broadcast.  A task gathers the distinct words of an Arrow
batch that it has not met lately, lays the symbols of all of them in one flat
array and merges in rounds: the pair keys of neighbouring symbols are looked up
by binary search in the sorted merge table, every word takes its lowest-ranked
pair, and all those merges are applied at once.  No shuffle: a document is
encoded where it is read.

Defined results: null text counts as empty (no ids, empty decoding); the marker
strings of special tokens in a text become their ids, as the library does;
repeated rows are encoded one by one; other columns are passed through and may
have any names.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

common.by_value(sys.modules[__name__])

NAME = "op6_bpe_codec"
ORACLE_SQL = None

#: The white space characters of Unicode below U+0250.
BLANK = "\t\n\x0b\x0c\r \x85\xa0"
#: Code points that this pattern module's character table counts as
#: letters or numbers and the library's older table doesn't.
NEWER = [x.split("-") for x in (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd "
    "a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a "
    "11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 "
    "16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 "
    "3d000-3fc3f ").split()]
#: Marks, and two letters, younger than the library's normalisation
#: table; it neither reorders nor composes them.
UNORDERED = [x.split("-") for x in (
    "7fd-7fd 898-89f 8ca-8d3 9fe-9fe c3c-c3c d3b-d3c eba-eba 1715-1715 1abf-1ace 1df6-1dfa a82c-a82c "
    "10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070-11070 1133b-1133b 1145e-1145e "
    "11839-1183a 11930-11930 11938-11938 1193d-1193e 11943-11943 119e0-119e0 11a34-11a34 11a47-11a47 "
    "11a99-11a99 11d42-11d42 11d44-11d45 11d97-11d97 11f41-11f42 16ff0-16ff1 1e08f-1e08f 1e130-1e136 "
    "1e2ae-1e2ae 1e2ec-1e2ef 1e4ec-1e4ef").split()]
#: Capitals younger than this Python's character table.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
         0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
#: Words whose ids a task keeps between batches; beyond it the store is emptied.
WORDS_KEPT = 300_000
#: Ids and decoded text that a task gathers before it hands them on.
OUT_BYTES = 2 << 20
#: The vocabulary goes to every executor; larger files are refused.
MAX_VOCABULARY = 1_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the others for
    the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    own_set = set(own)
    return [chr(b) if b in own_set else chr(next(rest)) for b in range(256)]


#: Texts without code points from here on are split with plain character classes.
PLAIN = 0x250


def latin_classes() -> tuple[str, str, str]:
    """Class bodies (white space, letters, numbers) of the code points below
    ``PLAIN``, for the standard pattern module."""
    def body(wanted) -> str:
        return "".join(f"\\u{c:04x}" for c in range(PLAIN) if wanted(chr(c)))

    return (body(lambda c: c in BLANK), body(lambda c: unicodedata.category(c)[0] == "L"),
            body(lambda c: unicodedata.category(c)[0] == "N"))


def character_class(ranges: list[list[str]]) -> str:
    return "[" + "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in ranges) + "]"


class Codec:
    """Flat arrays of one vocabulary, with ``encode``/``decode`` of batches."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        if size > MAX_VOCABULARY:
            raise ValueError(f"vocabulary of {size} entries; at most {MAX_VOCABULARY} are broadcast")
        self.tokens = np.full(size, "", dtype=object)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.special = special
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        # All occurrences of a word's lowest pair may be merged in one round if a
        # merge never makes a symbol that an earlier merge uses.
        first_use = np.full(size, len(pairs), dtype=np.int64)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.all_at_once = bool((first_use[made] > rank).all())
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], rank[order], made[order]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]

    def ready(self) -> Codec:
        """Compile patterns and empty the word store (once per task)."""
        blank, letter, number = latin_classes()
        pattern = self.pattern.replace(r"\s", blank).replace(r"\p{L}", letter).replace(r"\p{N}", number)
        self.plain = re.compile(pattern).findall
        self.unquoted = re.compile("|".join(p for p in pattern.split("|") if not p.startswith("'"))).findall
        self.unusual = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]").search
        self.unordered = re.compile(f"({character_class(UNORDERED)})")
        self.find = None
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        return self

    def older_letters(self) -> str:
        """The pattern, with the code points of ``NEWER`` counted as neither
        letters nor numbers."""
        gone = character_class(NEWER)
        letter, number = f"[\\p{{L}}--{gone}]", f"[\\p{{N}}--{gone}]"
        return (self.pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letter}{number}]")
                .replace(r"[\p{L}]", letter).replace(r"[\p{N}]", number))

    def words(self, text: str) -> list[str]:
        """Normalise (NFC, lower case character by character) and split."""
        if not text.isascii():
            if self.unordered.search(text):
                text = "".join(x if k % 2 else unicodedata.normalize("NFC", x)
                               for k, x in enumerate(self.unordered.split(text)))
            else:
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()
            if self.unusual(text):
                text = text.translate(LOWER)
                if self.find is None:
                    self.find = regex.compile("(?V1)" + self.older_letters()).findall
                return self.find(text)
        else:
            text = text.lower()
        return self.plain(text) if "'" in text else self.unquoted(text)

    def pair(self, ids: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made symbol) of the pairs that begin at positions ``at``;
        the rank is ``len(keys)`` where there is none inside the word."""
        nxt = np.minimum(at + 1, len(ids) - 1)
        keys = ids[at] << 20 | ids[nxt]
        k = np.searchsorted(self.keys, keys)
        k[k == len(self.keys)] = 0
        good = (self.keys[k] == keys) & (word[at] == word[nxt]) & (nxt > at)
        return np.where(good, self.rank[k], len(self.keys)), self.made[k]

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words: (flat ids, first index of each word and the end)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = self.inner[data]
        last = np.cumsum(length) - 1
        ids[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(raw)), length)
        rank, made = self.pair(ids, np.arange(len(ids)), word)
        done_ids, done_word = [], []
        none = len(self.keys)
        while len(ids):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, start)
            of = np.repeat(best, np.diff(np.r_[start, len(ids)]))
            live = of < none
            if not live.all():
                done_ids.append(ids[~live])
                done_word.append(word[~live])
                ids, word, rank, made, of = (x[live] for x in (ids, word, rank, made, of))
                if not len(ids):
                    break
            spots = np.flatnonzero(rank == of)
            if self.all_at_once:  # in a run of overlapping equal pairs every second one
                run = np.r_[True, np.diff(spots) != 1]
                nth = np.arange(len(spots)) - np.maximum.accumulate(np.where(run, np.arange(len(spots)), 0))
                spots = spots[nth % 2 == 0]
            else:
                spots = spots[np.r_[True, word[spots[1:]] != word[spots[:-1]]]]
            ids[spots] = made[spots]
            keep = np.ones(len(ids), dtype=bool)
            keep[spots + 1] = False
            ids, word, rank, made = ids[keep], word[keep], rank[keep], made[keep]
            spots -= np.arange(len(spots))
            changed = np.unique(np.r_[spots, spots[spots > 0] - 1])
            rank[changed], made[changed] = self.pair(ids, changed, word)
        if not done_ids:
            return np.empty(0, "<u4"), np.zeros(len(raw) + 1, np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        bounds = np.searchsorted(word[order], np.arange(len(raw) + 1))
        return ids[order].astype("<u4"), bounds

    def decode(self, ids) -> str:
        """Tokens joined by blanks: what the library does without a decoder."""
        return " ".join(self.tokens[np.asarray(ids, dtype=np.int64)])

    def learn(self, words: set[str]) -> None:
        new = list(words - self.ids.keys())
        if len(self.ids) + len(new) > WORDS_KEPT:
            self.ids.clear()
            self.text.clear()
            new = list(words)
        for token, i in self.special.items():
            self.ids[token], self.text[token] = i.to_bytes(4, "little"), token
        if new := [w for w in new if w not in self.special]:
            ids, bounds = self.merge_rounds(new)
            tokens, data, bounds = self.tokens[ids].tolist(), ids.tobytes(), bounds.tolist()
            for w, i, j in zip(new, bounds, bounds[1:]):
                self.ids[w] = data[4 * i:4 * j]
                self.text[w] = " ".join(tokens[i:j])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, their decoding) of each text."""
        todo: list[list[str]] = []
        held = 0

        def flush():
            self.learn(set().union(*todo))
            ids, text = self.ids.__getitem__, self.text.__getitem__
            for parts in todo:
                yield b"".join(map(ids, parts)), " ".join(map(text, parts))

        for t in texts:
            if self.cut:
                parts: list[str] = []
                for k, piece in enumerate(self.cut(t)):
                    if k % 2:
                        parts.append(piece)
                    else:
                        parts += self.words(piece)
            else:
                parts = self.words(t)
            todo.append(parts)
            held += len(parts)
            if held > WORDS_KEPT:
                yield from flush()
                todo, held = [], 0
        yield from flush()


def load(path: str) -> Codec:
    """Read a vocabulary file on the driver."""
    with open(path, encoding="utf-8") as f:
        return Codec(json.load(f))


def bpe(docs: DataFrame, path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Add ``n_tokens`` and, unless ``digest``, ``ids`` (array of int) and
    ``decoded`` (string); with ``digest`` their SHA-256 instead, so that the
    tokens themselves never leave the task.  Existing columns with these names
    are replaced."""
    codec = docs.sparkSession.sparkContext.broadcast(load(path))
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    kind = ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest
            else "n_tokens long, ids array<int>, decoded string")

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec.value.ready()
        for texts in batches:
            rows, weight = [], 0
            for ids, decoded in c.encode_batch([t or "" for t in texts]):
                if digest:
                    rows.append((len(ids) // 4, common.sha(ids),
                                 common.sha(decoded.encode("utf-8", "surrogatepass"))))
                else:
                    rows.append((len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32), decoded))
                    weight += len(ids) + len(decoded)
                if weight > OUT_BYTES:
                    yield pd.DataFrame(rows, columns=fields)
                    rows, weight = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=fields)

    out = common.fresh(docs, stem="bpe_out")
    keep = [f"`{c}`" for c in docs.columns if c.lower() not in fields]
    return docs.withColumn(out, run.asNondeterministic()(F.col(text))).select(
        *keep, *[F.col(out)[f].alias(f) for f in fields])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe(docs, path or default_path(), digest=True).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
