"""Main texts of web pages: parsing, decoding, held-out accuracy, the given pages."""

import html
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import SF, sf_dir_with

from promptspark.llm import boosted_trees, labelled_pages
from promptspark.llm import html_extraction as M
from promptspark.llm.html_dom import Pages

PAGE = "page_id long, url string, html string"


def parsed(text):
    pages = Pages()
    pages.add(text)
    return pages


def everything(text):
    pages = parsed(text)
    return pages.texts(np.ones(len(pages), bool))[0]


@pytest.mark.parametrize("text, want", [
    ("", ""), ("a  b\n c", "a b c"), ("<p>one<p>two", "one\n\ntwo"), ("<P>x &amp;amp; &copy;&nbsp;y</P>z", "x &amp; © y\n\nz"),
    ("a<b>b</b><i>c</i> <span class='x'>d</span>e", "abc de"), ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", "1\n\n2\n\n3\n\n4"),
    ("<script>if (a<b) '<p>no</p>'</script>yes<style>p{}</style>", "yes"), ("x<!-- <p>no</p> -->y<!-- open", "xy"),
    ("a < b > c <3", "a < b > c <3"), ("<table><tr><td>1<td>2<tr><td>3</table>4", "1\n\n2\n\n3\n\n4"),
    ("<p title='>'>ok</p></div></p>end", "ok\n\nend"), ("<div>a<button>no<div>yes</div></div>b", "a\n\nyes\n\nb"),
    ("<a href='x>y</a>", ""), ("one<br>two<br/>three<hr>four", "one two three\n\nfour"), ("<script>never closed", ""),
    ("<dl><dt>a<dd>b<dt>c</dl>", "a\n\nb\n\nc"), ("<svg><text>no</text></svg><p>y", "y")])
def test_texts_of_the_whole_page(text, want):
    assert everything(text) == want


def test_nodes_are_in_page_order_with_subtrees():
    pages = parsed("<div class='sideBar main-x'>t<p>u<b>v</b></p></div><section>w</section>")
    assert pages.tag == ["#page", "div", "#text", "p", "#text", "section", "#text"]
    assert pages.parent == [-1, 0, 1, 1, 3, 0, 5] and pages.end == [7, 5, 3, 5, 5, 7, 7]
    assert pages.tokens[1] == ("side", "bar", "main")
    # an unclosed quote, deep nesting and many stray ends take no quadratic time
    for text in ("<a \"" * 100_000, "<div>" * 50_000 + "x", "</p>" * 100_000 + "<p>x", "<" * 200_000, "<!--" * 100_000,
                 "<button>" * 20_000, "<p>" * 100_000, "<b class=xy>" * 20_000 + "</div>" * 20_000):
        parsed(text)


def test_decoding_finds_the_best_consistent_labels():
    rng = np.random.default_rng(4)
    for _ in range(60):
        pages = Pages()
        pages.runs.append([])
        pages._node("#page", (), -1)
        n = int(rng.integers(2, 8))
        for k in range(1, n):
            pages._node("p", (), int(rng.integers(max(0, k - 2), k)))
        # preorder: a parent must be the node before or one of its ancestors
        def ancestors(k):
            return [] if k < 0 else [k, *ancestors(pages.parent[k])]
        if any(pages.parent[k] not in ancestors(k - 1) for k in range(1, n)):
            continue
        pages.end = [max([j for j in range(n) if k in ancestors(j)]) + 1 for k in range(n)]
        score = np.log(rng.dirichlet(np.ones(3), n))
        leaf = [pages.end[k] - k == 1 for k in range(n)]
        def allowed(labels):
            return all((labels[k] != M.MIXED or not leaf[k])
                       and (k == 0 or labels[pages.parent[k]] in (M.MIXED, labels[k])) for k in range(n))
        best = max((x for x in itertools.product(range(3), repeat=n) if allowed(x)),
                   key=lambda x: sum(score[k, c] for k, c in enumerate(x)))
        assert M.decode(pages, score).tolist() == list(best)


def test_trees_learn_and_are_deterministic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = np.where(x[:, 0] * x[:, 1] > 0, 2, np.where(x[:, 2] > 0.3, 1, 0))
    a = boosted_trees.BoostedTrees(3).fit(x[:2000], y[:2000]).log_shares(x[2000:])
    assert (a.argmax(axis=1) == y[2000:]).mean() > 0.93 and np.allclose(np.exp(a).sum(axis=1), 1)
    b = boosted_trees.BoostedTrees(3).fit(x[:2000], y[:2000]).log_shares(x[2000:])
    assert (a == b).all()


def overlap(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(sum(a.values()) + sum(b.values()), 1)


@pytest.mark.parametrize("held_out, least", [(False, 0.96), (True, 0.93)])
def test_held_out_pages(held_out, least):
    """Other seeds; ``held_out`` pages name their parts with words never seen."""
    pages = Pages()
    texts = labelled_pages.pages(300, 4242, held_out)
    for h in texts:
        pages.add(h)
    truth = [t.replace(labelled_pages.MARK, "") for t in pages.texts(M.Extractor.truth(pages, labelled_pages.MARK)[0] == M.MAIN)]
    got = M.default_extractor().texts([h.replace(labelled_pages.MARK, "") for h in texts])
    assert np.mean([overlap(a, b) for a, b in zip(got, truth)]) > least


def article(text):
    """The article of a given page, by its own markup."""
    inner = re.search(r"<article>(.*?)</article>", text, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def test_query_on_the_given_pages(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = M.query(spark, SF).collect()
    assert len(got) == len(rows) and list(got[0].asDict()) == ["page_id", "url", "text", "n_chars"]
    for r in got:
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, article(rows[r.page_id].html), len(r.text))


def test_awkward_pages_and_clashing_names(spark, tmp_path):
    rows = [(1, "u", None), (1, None, ""), (None, None, "<p>"), (2, "u", "plain words only"),
            (3, "u", "<div>" * 3000 + "deep " * 50), (4, "u", "<article><p>" + "long text, you see. " * 100_000 + "</article>"),
            (5, "u", "\x00<p>😀 & &#x1F600; &bogus;</p>")]
    where = sf_dir_with(spark, tmp_path / "a", pages=spark.createDataFrame(rows, PAGE))
    got = {(r.page_id, r.url): r for r in M.query(spark, where).collect()}
    assert len(got) == 7 and got[1, "u"].text == "" and got[1, "u"].n_chars == 0 and got[None, None].text == ""
    assert got[4, "u"].text == ("long text, you see. " * 100_000).strip()
    assert M.query(spark, sf_dir_with(spark, tmp_path / "b", pages=spark.createDataFrame([], PAGE))).count() == 0
    clash = spark.createDataFrame([("old", 9, "<p>x", 1)], "text string, n_chars int, html string, main_out int")
    assert M.extract(clash).columns == ["html", "main_out", "text", "n_chars"]
