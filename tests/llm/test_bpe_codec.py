import hashlib
import random

import numpy as np
import pytest
from llm_cases import awkward, awkward_rows, empty, sf_dir_with

from promptspark.llm import bpe_codec as M

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = M.default_path()
    return M.load(path).ready(), tokenizers.Tokenizer.from_file(path)


def agree(both, texts):
    codec, library = both
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, (ids, decoded), w in zip(texts, codec.encode_batch(texts), want):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids, ascii(text[:80])
        assert decoded == library.decode(w.ids, skip_special_tokens=False)
        assert codec.decode(w.ids) == decoded


def test_same_as_the_library(both):
    rng = random.Random(1)
    pool = [chr(i) for i in range(0x3000) if chr(i).isprintable()]
    texts = ["", " ", "a<|endoftext|>b <|startoftext|>", "<|STARTOFTEXT|>", "ΑΣ ΣΑΣ İstanbul ǅ", "a" * 3000, "ab" * 2000,
             "." * 2001, "it's they'LL 123 ½ ２３ \u0085x y\x1cz\x1fq​w᠎k j́"]
    texts += ["".join(rng.choice(pool) for _ in range(50)) for _ in range(300)]
    texts += ["".join(rng.choice("ab aaAA<|>endoftxİΣ'sdm") for _ in range(80)) for _ in range(300)]
    agree(both, texts)


def test_every_letter_class(both):
    agree(both, ["a" + chr(i) + "1" for i in range(0x250, 0x11000) if not 0xD800 <= i < 0xE000][::7])


def test_one_merge_a_round_gives_the_same(both):
    codec, _ = both
    words = ["banana", "aaaaaaa", "mississippi", "ababababab", "th", "x"]
    ids, bounds = codec.merge_rounds(words)
    codec.all_at_once = False
    try:
        slow, slow_bounds = codec.merge_rounds(words)
    finally:
        codec.all_at_once = True
    assert ids.tolist() == slow.tolist() and bounds.tolist() == slow_bounds.tolist()


def test_query_on_awkward_tables(spark, tmp_path, both):
    _, library = both
    d = sf_dir_with(spark, tmp_path, documents=awkward(spark).withColumnRenamed("lang", "ids"))
    want = []
    for row in awkward_rows():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want.append((str(row[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in M.query(spark, d).collect()]
    assert sorted(got) == sorted(want)


def test_other_columns_and_empty_table(spark):
    docs = empty(spark).withColumnRenamed("lang", "bpe_out")
    out = M.bpe(docs, M.default_path())
    assert out.columns == [*docs.columns, "n_tokens", "ids", "decoded"] and out.count() == 0
