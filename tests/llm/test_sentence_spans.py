import collections
import random

from llm_cases import awkward, awkward_rows, empty, sf_dir_with

from promptspark.llm import sentence_spans as M

LAST = 2 ** 63 - 1


def words(s):
    return s.encode().translate(M.WORD).split()


def brute(rows):
    """(id, text) -> removed sentence numbers."""
    first, runs = {}, []
    for i, t in rows:
        place = i if i is not None else LAST
        filled = [(k, words(t[a:b])) for k, (a, b) in enumerate(M.sentences_of(t)) if words(t[a:b])]
        found = False
        for x in range(len(filled)):
            total = 0
            for y in range(x, len(filled)):
                total += len(filled[y][1])
                if total >= M.LONG_WORDS or (y - x + 1 >= M.SENTENCES and total >= M.MIN_WORDS):
                    found = True
                    runs.append((place, t, filled[x][0], filled[y][0], str([w for _, w in filled[x:y + 1]])))
                    break
        if filled and not found and sum(len(w) for _, w in filled) >= M.SHORT_WORDS:
            runs.append((place, t, filled[0][0], filled[-1][0], str([w for _, w in filled])))
    for place, _, a, _, key in runs:
        first[key] = min(first.get(key, (place, a)), (place, a))
    out = collections.defaultdict(set)
    for place, t, a, b, key in runs:
        if (place, a) > first[key]:
            out[place, t] |= set(range(a, b + 1))
    return sorted((str(i), len(out[i if i is not None else LAST, t]),
                   ",".join(map(str, sorted(out[i if i is not None else LAST, t])))) for i, t in rows)


def digest(df):
    return sorted((str(r.doc_id), r.n_removed, r.removed_sentences) for r in df.collect())


def test_query_on_awkward_tables(spark, tmp_path):
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "text_key"))
    assert digest(M.query(spark, d)) == brute([r[:2] for r in awkward_rows()])


def test_random_sentences(spark, tmp_path):
    rng = random.Random(4)
    bank = [" ".join(rng.choice(["of", "the", "Is", "a", "b"]) for _ in range(rng.randint(1, 8))) + rng.choice(". ! ? ...".split())
            for _ in range(25)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(bank) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    d = sf_dir_with(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert digest(M.query(spark, d)) == brute(rows)


def all_runs(rows):
    """(id, text) -> removed sentence numbers, from every run of any length."""
    first, runs = {}, []
    for i, t in rows:
        filled = [(k, words(t[a:b])) for k, (a, b) in enumerate(M.sentences_of(t)) if words(t[a:b])]
        mine = []
        for x in range(len(filled)):
            for y in range(x, len(filled)):
                total = sum(len(w) for _, w in filled[x:y + 1])
                if total >= 40 or (y > x and total >= 12):
                    mine.append((x, y))
        if filled and not mine and sum(len(w) for _, w in filled) >= 8:
            mine = [(0, len(filled) - 1)]
        runs += [(i, filled[x][0], filled[y][0], str([w for _, w in filled[x:y + 1]])) for x, y in mine]
    for i, a, _, key in runs:
        first[key] = min(first.get(key, (i, a)), (i, a))
    out = {i: set() for i, _ in rows}
    for i, a, b, key in runs:
        if (i, a) > first[key]:
            out[i] |= set(range(a, b + 1))
    return sorted((str(i), len(s), ",".join(map(str, sorted(s)))) for i, s in out.items())


def test_against_all_runs(spark, tmp_path):
    rng = random.Random(8)
    bank = [" ".join(f"v{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 11, 14, 25, 41]))) + "."
            for _ in range(60)]
    passages = [" ".join(rng.choice(bank) for _ in range(rng.randint(2, 5))) for _ in range(25)]
    rows = []
    for i in range(250):
        own = [" ".join(f"u{i}x{rng.randrange(99)}" for _ in range(rng.randint(1, 9))) + "." for _ in range(3)]
        parts = own + [rng.choice(passages + bank) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    d = sf_dir_with(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert digest(M.query(spark, d)) == all_runs(rows)


def test_last_sentence_of_a_repeated_passage(spark):
    def sentence(name, n):
        return " ".join(f"{name}{j}" for j in range(n)) + "."

    long = " ".join([sentence("a", 25), sentence("b", 25), sentence("c", 10)])
    two = sentence("d", 9) + " " + sentence("e", 6)
    rows = [(1, f"Mine. {long} Rest of one. {two}"), (2, f"Yours. {long} Another rest. {two}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert M.dedup_spans(docs).where("doc_id = 2").first().text == "Yours. Another rest. "


def test_texts_without_the_sentences(spark):
    passage = " ".join(f"Word{k} goes here to fill sentence {k}." for k in range(12))
    rows = [(1, f"First one has this. {passage} Its own end."), (2, f"Another start here. {passage} A different end."),
            (3, None), (4, "Nothing to see here.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    got = {r.doc_id: r.body for r in M.dedup_spans(docs, text="body").collect()}
    assert got == {1: rows[0][1], 2: "Another start here. A different end.", 3: None, 4: rows[3][1]}


def test_empty_table(spark):
    assert M.dedup_spans(empty(spark)).count() == 0
