import hashlib
import random
import re

from llm_cases import SF, awkward, awkward_rows, empty, sf_dir_with

from promptspark.llm import credential_links as M

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def brute(t):
    t = t or ""
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    s += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 16]
    s += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(t) if m.end() - m.start() >= 32]
    s.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
    return [sum(x[1] == k for x in s) for k in range(3)] + [hashlib.sha256(joined.encode()).hexdigest()]


def digest(rows):
    return sorted([str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256] for r in rows)


def test_random_texts(spark, tmp_path):
    rng = random.Random(1)
    parts = ["token", "API_KEY", "apikey", "secret=", '"', "'", "=", ":", " ", "abcdefgh", "0123456789abcdef", "AKIA",
             "ABCDEFGH1234", "é", "😀", "\n", "a", "secret", "K"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(2500)]
    d = sf_dir_with(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert digest(M.query(spark, d).collect()) == sorted([str(i), *brute(t)] for i, t in rows)


def test_query_on_awkward_tables(spark, tmp_path):
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "secrets"))
    assert digest(M.query(spark, d).collect()) == sorted([str(r[0]), *brute(r[1])] for r in awkward_rows())


def test_weak_parts_need_a_partner(spark):
    key = "Zx9" * 14
    rows = [(1, "client_id = abcdefgh then https://api.example.com/v1 end"), (2, "client_id = abcdefgh\n\nhttps://api.example.com"),
            (3, f'client_id: "user-1234" x {key} y'), (4, "https://a.example.com only"), (5, f"{key} only"),
            (6, "client_id = abcdefgh" + " x" * 400 + " https://api.example.com"),
            (7, "token = abcdefgh1234 at https://api.example.com"), (8, f"token={key} alone")]
    rows += [(100 + k, rows[0][1]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in M.scan(docs).collect()}
    assert got[1] == [("identifier", 0, 20), ("endpoint", 26, 52)] and all(got[100 + k] == got[1] for k in range(30))
    assert got[2] == got[4] == got[5] == got[6] == []
    assert got[3] == [("identifier", 0, 21), ("key", 25, 67)]
    assert got[7] == [("assign", 0, 20), ("endpoint", 24, 47)]
    assert got[8] == [("assign", 0, 48)]


def test_prefixed_names_and_keys_of_any_length(spark):
    short, storage = "a1B2" * 5, "Zx9+" * 21 + "Qw=="
    rows = [(1, f"aws_access_key_id=abcdefgh {short}"), (2, "AZURE_CLIENT_ID=abcdefgh https://api.example.com"),
            (3, 'github_client_id: "user1" https://api.example.com'), (4, f"https://store.example.com {storage} x"),
            (5, f"account_id=abcdefgh {'x7' * 15}"), (6, f"{short} only"), (7, f"{storage} only"),
            (8, f"https://example.com/{short}/{short[:8]} alone"), (9, f"my_user_id={short} alone"),
            (10, f"client_id=abcdefgh {'-' * 30} {short[:19]}"), (11, "awsAccessKeyId=abcdefgh https://api.example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in M.scan(docs).collect()}
    assert got[1] == [("identifier", 0, 26), ("key", 27, 47)]
    assert got[2] == [("identifier", 0, 24), ("endpoint", 25, 48)]
    assert got[3] == [("identifier", 0, 24), ("endpoint", 26, 49)]
    assert got[4] == [("endpoint", 0, 25), ("key", 26, 26 + 88)]
    assert got[5] == [("identifier", 0, 19), ("key", 20, 50)]
    assert got[11] == [("identifier", 0, 23), ("endpoint", 24, 47)]
    assert got[6] == got[7] == got[8] == got[9] == got[10] == []


def test_linked_parts_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for t in range(3):
        for _ in range(40):
            kind = rng.choice(["identifier", "key", "endpoint", "assign"])
            a = rng.randrange(3000)
            base = kind == "assign"
            rows.append((f"t{t}", (a, 0, kind, a + rng.randint(5, 60), base), M.ROLE.get(kind, kind), rng.randrange(2)))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "text_key string, part struct<start:long,rank:int,kind:string,end:long,base:boolean>,"
                                     " role string, paragraph int")
    want = {(k, p) for k, p, role, par in rows if not p[4] and any(
        k == k2 and role != role2 and par == par2 and p[0] <= q[3] + 100 and q[0] <= p[3] + 100
        for k2, q, role2, par2 in rows)}
    assert {(r.text_key, tuple(r.part)) for r in M.linked_parts(df, 100).collect()} == want


def test_no_python_in_the_plan(spark):
    plan = M.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert M.scan(empty(spark)).count() == 0
