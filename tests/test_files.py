import json

import pytest

from promptspark.operators import pricing
from promptspark.sources import files


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "sub" / "b.v2.JSON").write_text('[{"role": "user", "content": "hi"}]')
    (tmp_path / "sub" / "deep" / "c.md").write_text("# head\nbödy")
    (tmp_path / "sub" / "d.prompt").write_text("")
    (tmp_path / "e.rst").write_text("not a prompt")
    (tmp_path / "f.hrt").write_text("@TASK")
    (tmp_path / "g.txt").write_bytes(b"\xff\xfe bad")
    return tmp_path


def test_scan(spark, folder):
    rows = files.scan_files(spark, str(folder))
    good, bad = files.readable(rows)
    assert {(r.id, r.format, r.text) for r in good.collect()} == {
        ("a", "text", "plain text"), ("b.v2", "json", '[{"role": "user", "content": "hi"}]'),
        ("c", "markdown", "# head\nbödy")}  # Spark lists no empty files
    assert [r.path.rsplit("/")[-1] for r in bad.collect()] == ["g.txt"]


def test_mining_scan(spark, folder, tmp_path_factory):
    assert files.scan_for_patterns(spark, str(folder)).count() == 4
    with pytest.raises(ValueError):
        files.scan_for_patterns(spark, str(tmp_path_factory.mktemp("none")))


def test_one_file(spark, folder):
    assert [r.text for r in files.read_prompt(spark, str(folder / "sub" / "deep" / "c.md")).collect()] == ["# head\nbödy"]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_library_round_trip(spark, tmp_path, fmt):
    rows = [("role_001", "You are, an \"expert\"", 3, 4, "role"), ("general_002", "x", 2, 1, "general")]
    lib = spark.createDataFrame(rows, files.PATTERN_SCHEMA)
    files.save_patterns(lib, str(tmp_path / "lib"), fmt)
    back = files.load_patterns(spark, str(tmp_path / "lib"), fmt)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(ValueError):
        files.save_patterns(lib.unionByName(lib), str(tmp_path / "again"), fmt)


def test_prices(spark, tmp_path, monkeypatch):
    p = tmp_path / "prices.json"
    p.write_text(json.dumps([{"provider": "openai", "model": "gpt-4", "input_per_1k": 1.0, "output_per_1k": 2.0}]))
    monkeypatch.setenv("PRICES_FOR_TEST", str(p))
    for got in (files.load_prices(spark, str(p)), files.load_prices(spark, env="PRICES_FOR_TEST")):
        models = pricing.models_table(spark, [tuple(r) for r in got.collect()])
        reg = pricing.registry(models).where("key = 'gpt-4'").collect()
        assert [(r.input_per_1k, r.output_per_1k) for r in reg] == [(1.0, 2.0)]
    assert files.load_prices(spark).count() == 0


def test_results(spark, tmp_path):
    p = tmp_path / "results.json"
    p.write_text(json.dumps({"run": 1, "results": [{"id": "a", "ratio": 0.5}, {"id": "b", "ratio": None}]}))
    assert sorted((r.id, r.ratio) for r in files.load_results(spark, str(p)).collect()) == [("a", 0.5), ("b", None)]
    df = spark.createDataFrame([("a", [1, 2])], "id string, xs array<int>")
    for fmt in ("json", "csv", "parquet"):
        files.write(df, str(tmp_path / fmt), fmt)
    assert files.load_results(spark, str(tmp_path / "parquet")).count() == 1
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().xs == "[1,2]"
    with pytest.raises(ValueError):
        files.write(df, str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_many_rows_with_line_breaks_in_one_file(spark, tmp_path, fmt):
    odd = ["a\nb", 'say "x", then\r\n"y"', "  blanks  ", "", None, "\\", 'back\\"slash', "ü\t😀", "{\"a\": 1}", "#no comment"]
    rows = [(f"id_{k:04d}", odd[k % len(odd)] if k % 3 else f"text {k}\n{odd[k % len(odd)]}", k, None if k % 7 == 0 else 1,
             "general") for k in range(1000)]
    lib = spark.createDataFrame(rows, files.PATTERN_SCHEMA).coalesce(1)
    files.save_patterns(lib, str(tmp_path / "lib"), fmt)
    assert len(list((tmp_path / "lib").glob("part-*"))) == 1
    assert sorted(map(tuple, files.load_patterns(spark, str(tmp_path / "lib"), fmt).collect())) == rows
    prices = [("p", f"m{k}", k / 8, None) for k in range(200)]
    files.write(spark.createDataFrame(prices, files.PRICE_SCHEMA).coalesce(1), str(tmp_path / "prices"), fmt)
    assert sorted(map(tuple, files.load_prices(spark, str(tmp_path / "prices"), fmt=fmt).collect())) == sorted(prices)
    files.write(spark.createDataFrame([(str(k), "x\ny") for k in range(500)], "id string, t string").coalesce(1),
                str(tmp_path / "results"), fmt)
    back = files.load_results(spark, str(tmp_path / "results"), fmt)
    assert back.count() == 500 and {r.t for r in back.collect()} == {"x\ny"}


def test_json_documents_and_lines_in_one_folder(spark, tmp_path):
    one = {"provider": "a", "model": "m1", "input_per_1k": 1.0, "output_per_1k": 2.0}
    (tmp_path / "lines.json").write_text("\n" + "\n".join(json.dumps({**one, "model": f"l{k}"}) for k in range(5)))
    (tmp_path / "pretty.json").write_text(json.dumps([one, {**one, "model": "m2"}], indent=2))
    (tmp_path / "single.json").write_text(json.dumps({**one, "model": "m3"}, indent=1))
    (tmp_path / "array.json").write_text(json.dumps([{**one, "model": "m4"}, {**one, "model": "m5"}]))
    got = files.load_prices(spark, str(tmp_path), fmt="json")
    assert sorted(r.model for r in got.collect()) == ["l0", "l1", "l2", "l3", "l4", "m1", "m2", "m3", "m4", "m5"]
    lines, whole = files.json_layouts(spark, str(tmp_path))
    assert sorted(p.rsplit("/", 1)[1] for p in whole) == ["pretty.json", "single.json"] and len(lines) == 2
