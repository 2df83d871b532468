"""Small tables with the awkward cases that every operator must take."""

import random
import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(60)) + ".\n" + " ".join(rng.choice(words) for _ in range(40))
             for _ in range(12)]
    rows = [(k, t, "en", "src0", len(t)) for k, t in enumerate(prose)]
    rows += [(20, prose[0], "en", None, None), (21, prose[0], None, "s", 1), (21, prose[0], None, "s", 1),
             (22, prose[1].replace(words[0], words[1]) + " end", "en", "s", 0), (23, "", "en", "s", 0),
             (24, None, None, None, None), (25, " \n\t\n", "en", "s", 4), (None, prose[2], "en", "s", 3),
             (None, None, None, None, None), (26, "one two", "en", "s", 7), (27, "one two", "en", "s", 7),
             (28, " ".join(rng.choice(words) for _ in range(30_000)), "en", "s", 1),
             (29, "x" * 200_000, "en", "s", 1), (30, "😀 " * 400 + "Ünïcödé x", "en", "s", 1),
             (5, "same id as another document but a different text than that one has here", "en", "s", 1)]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sf_dir_with(spark, path, **tables):
    """A folder of parquet tables for a query."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
