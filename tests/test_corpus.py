"""Sinks, state and tokenizers of the corpus plans, on small made inputs."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from warraq.functions import html
from warraq.operators import ordering, tokenizers
from warraq.plans import catalog
from warraq.sources import state


def test_positions_with_ties_nulls_and_none(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, "x") for i in range(500)], "id int, k int, position0 string")
    got = [(r.id, r.position) for r in ordering.positioned(df, [F.asc("k"), F.asc("id")]).collect()]
    want = sorted(range(500), key=lambda i: (-1 if i % 5 == 0 else i % 3, i))
    assert sorted(got, key=lambda x: x[1]) == [(i, n) for n, i in enumerate(want, 1)]
    assert ordering.positioned(df.limit(0), [F.asc("id")]).count() == 0
    assert ordering.zipped(df.select("id"), [F.asc("id")], df.limit(7).select(F.col("id").alias("other")), [F.asc("other")]).count() == 7


def test_documents_reports_and_days(spark, tmp_path):
    path = f"file://{tmp_path}/state.json"
    assert state.read_document(spark, path, {}) == {}
    for value in ({"a": "سلام", "n": 1}, {"a": None}):
        state.write_document(spark, path, value)
        assert state.read_document(spark, path) == value
    assert [p for p in glob.glob(f"{tmp_path}/*") if not p.endswith("state.json")] == []
    state.write_report(spark.createDataFrame([("x", 1), (None, 2)], "k string, n int"), f"file://{tmp_path}/report.json")
    assert json.load(open(tmp_path / "report.json")) == [{"k": "x", "n": 1}, {"k": None, "n": 2}]
    day = spark.createDataFrame([("1", "t")], "id string, text string")
    for date in ("2024-01-01", "2024-01-02", "2024-01-02"):
        state.write_day(day, f"file://{tmp_path}/days", date)
    assert spark.read.json(f"file://{tmp_path}/days").count() == 2


def test_run_log_by_key_and_repeat(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for run, rows in (("1", [("50", 3, 1), ("77", 1, 0)]), ("2", [("50", 2, 2)]), ("2", [("50", 5, 2)])):
        state.log_run(spark, path, run, spark.createDataFrame(rows, "sub string, collected bigint, dropped bigint"), "sub")
    log = spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))
    got = {(r.run, r["sub"]): (r.collected, r.total_collected, r.total_dropped) for r in state.cumulative(log, "sub", ["collected", "dropped"]).collect()}
    assert got == {("1", "50"): (3, 3, 1), ("1", "77"): (1, 1, 0), ("2", "50"): (5, 8, 3), ("1", None): (4, 4, 1), ("2", None): (5, 9, 3)}


def test_cache_release_and_csv(spark, tmp_path):
    made = []
    df = spark.createDataFrame([('a "b", c', 1), ("é", 2)], "token string, n int")
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert state.cached_sample(spark, f"file://{tmp_path}/sample", make).count() == 2
    assert len(made) == 1
    state.release(df, f"file://{tmp_path}/all", f"file://{tmp_path}/copy")
    assert spark.read.parquet(f"file://{tmp_path}/copy").count() == 2
    state.vocabulary_csv(df.coalesce(1), f"file://{tmp_path}/csv")
    rows = list(csv.reader(open(glob.glob(f"{tmp_path}/csv/*.csv")[0])))
    assert rows == [["token", "n"], ['a "b", c', "1"], ["é", "2"]]


def test_report_template():
    text = "| Documents | **1,200** |\n| Tokens | **x** | y |\n| Documents | **7** |"
    got, missing = state.fill_report(text, {"Documents": f"{1234567:,}", "Tokens": "2.50", "Absent": "1"})
    assert got == "| Documents | **1,234,567** |\n| Tokens | **2.50** | y |\n| Documents | **7** |" and missing == ["Absent"]


def test_seeds_lists_and_pasted_requests(spark, tmp_path):
    seeds = "channels:\n - https://www.youtube.com/@one\n - UCabcdefghijklmnopqrstuv\n - {handle: two, max_videos: 5}\n - {channel_id: UCx, handle: three}\n - {max_videos: 2}\n"
    got = [tuple(r) for r in state.seed_channels(spark, seeds).collect()]
    assert got == [("one", None, None), (None, "UCabcdefghijklmnopqrstuv", None), ("two", None, 5), (None, "UCx", None), (None, None, 2)]
    assert state.seed_channels(spark, "").count() == 0
    (tmp_path / "tree.json").write_text('[\n {"id": "1",\n "kids": ["2"]},\n {"id": "2", "kids": []}\n]')
    assert state.multiline_json(spark, f"file://{tmp_path}/tree.json", "id string, kids array<string>").count() == 2
    command = "curl 'https://forum.example/' \\\n -H 'accept: text/html' \\\n -b 'sid=abc; tok=x=y' \\\n -H 'user-agent: Agent/1.0 (X; Y)' \\\n --data-raw 'cookie: no'"
    assert state.pasted_request(command) == {"cookie_header": "sid=abc; tok=x=y", "user_agent": "Agent/1.0 (X; Y)"}
    assert state.cookies("sid=abc; tok=x=y; ; bare; sid=d") == {"sid": "d", "tok": "x=y"}
    assert state.pasted_request("curl x") == {"cookie_header": None, "user_agent": None}


TEXTS = ["hello there", "", None, "سلام 😀 é", "a\nb\n\nc", "<|endoftext|>"]


@pytest.mark.parametrize("name", tokenizers.NAMES)
def test_ids_texts_and_pieces(spark, name):
    encode, decode = tokenizers.load(name)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    x = df.select("i", "t", tokenizers.ids(F.col("t"), name).alias("ids"), tokenizers.piece_count(F.col("t"), name).alias("n"), tokenizers.pieces(F.col("t"), name).alias("p"))
    for r in x.withColumn("back", tokenizers.text_of(F.col("ids"), name)).withColumn("joined", tokenizers.joined(F.col("p"))).collect():
        if r.t is None:
            assert r.ids is None and r.n is None and r.p is None and r.back is None
            continue
        assert r.ids == encode(r.t) and r.n == len(r.ids) and r.back == decode(r.ids)
        if name.startswith("byte"):
            assert r.back == r.t and r.joined == r.t.strip()


def test_byte_runs_newlines_and_fertility(spark):
    df = spark.createDataFrame([(["▁a", "<0xF0>", "<0x9F>", "<0x8C>", "<0x9B>", "b", "<0xC3>"],)], "p array<string>")
    assert df.select(tokenizers.joined(F.col("p"))).first()[0] == "a🌛b�"
    t = spark.createDataFrame([("a\n\nb [NEWLINE]c",)], "t string").select(tokenizers.restore_newlines(tokenizers.keep_newlines(F.col("t"))))
    assert t.first()[0] == "a\n\nb\nc"
    words = spark.createDataFrame([("hello", "latin", 3), ("سلام", "arabic", 2), ("hello", "latin", 1)], "word string, script string, n int")
    encode, _ = tokenizers.load("byte_bpe_50k")
    got = {(r.script): (r.words, r.pieces) for r in tokenizers.word_fertility(words, ("byte_bpe_50k",)).collect()}
    a, b = len(encode("hello")), len(encode("سلام"))
    assert got == {"latin": (4, 4 * a), "arabic": (2, 2 * b), "ALL": (6, 4 * a + 2 * b)}
    assert {n for n, _ in tokenizers.discover()} >= set(tokenizers.NAMES)


def test_page_columns(spark):
    page = '<a id="thread_title_t1" href="#"><b>Thread One</b></a><div class="pagenav"><a rel="next" href="#">x</a></div>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    got = df.select(html.threads_column(F.col("h")).alias("t"), html.has_next_column(F.col("h")).alias("n"), html.links_column(F.col("h")).alias("l")).collect()
    assert [(len(r.t), r.n, r.l) for r in got] == [(1, True, []), (0, False, []), (0, False, [])] and got[0].t[0].title == "Thread One"


def test_fertility_queries(spark, sf):
    rows = catalog.queries()["tokenizer_fertility"](spark, sf).collect()
    assert {r.tokenizer for r in rows} == set(tokenizers.NAMES) and all(r.pieces >= r.words or r.tokenizer == "word_bpe_49k" for r in rows)
    for name in tokenizers.NAMES:
        own = [r for r in rows if r.tokenizer == name]
        assert sum(r.pieces for r in own if r.script != "ALL") == next(r.pieces for r in own if r.script == "ALL")
