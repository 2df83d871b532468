import collections
import random
import re

from llm_cases import SF, awkward, awkward_rows, blank_words, empty, sf_dir_with

from promptspark.llm import decision_lists as M

LABELS = "doc_id long, quality int, toxic int"


def brute(t):
    t = t or ""
    w = blank_words(t)
    lines = [x for x in t.split("\n") if blank_words(x)]
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside),
            len(w) < 10 or 100 * len(inside) > 20 * len(w)]


def test_base_counts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "# ", "é\t", "\x0b", "&", "x y z u v w "])
                        for _ in range(rng.randint(0, 60)))) for i in range(400)]
    d = sf_dir_with(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"),
                    labels=spark.createDataFrame([], LABELS))
    got = {r.doc_id: r for r in M.query(spark, d).collect()}
    for i, t in rows:
        r = got[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == brute(t)
        assert r.kept == (not r.base_failed)  # no labels, no rules


def test_query_on_awkward_tables(spark, tmp_path):
    labels = [(0, 1, 0), (0, 1, 0), (1, 0, None), (None, 0, 0), (2, None, 1), (3, 7, 0), (999, 0, 0)]
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "kept"),
                    labels=spark.createDataFrame(labels, LABELS))
    got = sorted([str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed]
                 for r in M.query(spark, d).collect())
    assert got == sorted([str(r[0]), *brute(r[1])] for r in awkward_rows())


def cases(spark, n, seed=3):
    """Bad exactly where (symbols > 0.2 and upper > 0.5) or bars > 0.6."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        f = {x: rng.choice([0.0, rng.random()]) for x in M.GRID}
        f["n_words"], f["word_length"] = float(rng.randint(10, 3000)), rng.uniform(2, 9)
        bad = (f["symbol_share"] > 0.2 and f["upper_share"] > 0.5) or f["bar_share"] > 0.6
        rows.append((bad, k % 3 == 0, *f.values()))
    return rows, spark.createDataFrame(rows, "bad boolean, prune boolean, " + ", ".join(f"{f} double" for f in M.GRID))


def test_learns_and_holds_out(spark):
    _, train = cases(spark, 900)
    rules = M.learn(train)
    assert rules
    rows, test = cases(spark, 600, seed=8)
    hit = [r.v is not None for r in test.select(M.verdict(rules).alias("v")).collect()]
    right = sum(a == b[0] for a, b in zip(hit, rows))
    assert right / len(rows) > 0.95


def test_no_rule_without_worth(spark):
    rng = random.Random(1)
    rows, _ = cases(spark, 300)
    noise = [(rng.random() < .1, *r[1:]) for r in rows]
    df = spark.createDataFrame(noise, "bad boolean, prune boolean, " + ", ".join(f"{f} double" for f in M.GRID))
    assert M.learn(df) == []


def test_held_out_accuracy_on_the_labels(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    rules = M.fit(docs, labels.where("doc_id % 4 <> 0"))
    test = M.judge(docs, rules).join(labels.where("doc_id % 4 = 0"), "doc_id").where("NOT base_failed")
    r = test.selectExpr("avg(int(kept = (quality = 1))) a", "sum(int(quality = 1 and not kept)) w").first()
    assert r.a > 0.95 and r.w <= 2


def test_ordered_conditional_expression(spark):
    a, b = (M.Literal("x", True, 1.0),), (M.Literal("x", True, 0.0), M.Literal("y", False, 5.0))
    df = spark.createDataFrame([(2.0, 1.0), (0.5, 5.0), (0.5, 6.0), (0.0, 0.0)], "x double, y double")
    assert [r.v for r in df.select(M.verdict([a, b]).alias("v")).collect()] == [1, 2, None, None]
    assert str(b[1]) == "y <= 5"


def test_columns_pass_through_and_empty_table(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = awkward(spark).withColumnRenamed("lang", "quality_mark")
    assert M.keep_good(docs, labels).columns == docs.columns
    assert M.keep_good(empty(spark), labels).count() == 0


def test_no_python_in_the_plan(spark):
    plan = M.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
