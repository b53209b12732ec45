"""Operators against brute force on small fixtures, with nulls, ties, repeats, empty tables, clashing names."""

import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.functions import html
from warraq.operators import crawl, hotkeys, neardup, ngram, sampling
from warraq.sources import records
from warraq.streaming import incremental


def _hot(spark, rows):
    # Extra columns named like the operator's own.
    return spark.createDataFrame(rows, "k string, item string, text string, day string, n int, records int, key_value int")


ROWS = [("a", f"v{i % 3}", "x" * (i % 7), f"2020-01-{i % 9 + 1:02d}", 1, 2, 3) for i in range(60)] + [(None, "v", None, None, 0, 0, 0)] * 5 + [("b", None, "", "2021-01-01", 1, 1, 1)] * 2 + [("c", "v", "é😀", None, 1, 1, 1)]


def test_per_key(spark):
    got = {r.key_value: (r.records, r["items"], r.chars, r.latest) for r in hotkeys.per_key(_hot(spark, ROWS), "k", "item", "text", "day").collect()}
    want = defaultdict(lambda: [0, set(), 0, None])
    for k, item, text, day, *_ in ROWS:
        w = want[k]
        w[0] += 1
        w[2] += len(text or "")
        if item:
            w[1].add(item)
        if day and (w[3] is None or day > w[3]):
            w[3] = day
    assert got == {k: (w[0], len(w[1]), w[2], w[3]) for k, w in want.items()}


def test_heavy_keys_by_refinement(spark):
    rows = [("a",)] * 400 + [("b",)] * 31 + [(None,)] * 300 + [(f"k{i}",) for i in range(269)]
    df = spark.createDataFrame(rows, "k string")
    assert {(r.key_value, r.records, r.share) for r in hotkeys.heavy_keys(df, "k", 0.03).collect()} == {("a", 400, 0.4), ("b", 31, 0.031)}
    assert {r.key_value for r in hotkeys.heavy_keys(df, "k", 0.031).collect()} == {"a", "b"}
    assert {r.key_value for r in hotkeys.heavy_keys(df, "k", 0.0311).collect()} == {"a"}
    assert hotkeys.heavy_keys(df.limit(0), "k").count() == 0 and hotkeys.heavy_keys(df.filter("k is null"), "k").count() == 0


def test_quantiles_of_any_size_and_none_out_of_range(spark):
    r = np.random.RandomState(1)
    rows = [("ab"[i % 2] if i % 7 else None, int(v)) for i, v in enumerate(r.randint(0, 1 << 45, 500))]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {(x.key_value, x.prob): x.value for x in hotkeys.quantiles(df, "k", F.col("v"), [0.1, 0.5, 1.0]).collect()}
    for k in ("a", "b", None):
        vs = sorted(v for kk, v in rows if kk == k)
        assert [got[k, p] for p in (0.1, 0.5, 1.0)] == [vs[max(1, int(np.ceil(p * len(vs)))) - 1] for p in (0.1, 0.5, 1.0)]
    with pytest.raises(ValueError, match="bits"):
        hotkeys.quantiles(df, "k", F.col("v"), [0.5], bits=32)
    with pytest.raises(ValueError, match="non-negative"):
        hotkeys.quantiles(df, "k", -F.col("v"), [0.5])


def test_slots_are_ranks(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0] if i % 11 else None) for i in range(3000)], "id bigint, s string")
    want = {(r.id, (r.rank > 5) + (r.rank > r.size * 0.5)) for r in sampling.ranked(df, "id", "s", 3).collect()}
    assert {(r.id, r.slot) for r in sampling.slots(df, "id", "s", 3, lambda n: [F.lit(5), n * 0.5]).collect()} == want


def test_hot_keys_and_quantiles(spark):
    df = _hot(spark, ROWS)
    res = hotkeys.per_key(df, "k", "item", "text", "day")
    assert {r.key_value for r in hotkeys.hot_keys(res, 0.5).collect()} == {"a"}
    got = {(r.key_value, r.prob): r.value for r in hotkeys.quantiles(df, "k", F.length("text"), [0.0, 0.5, 1.0], bits=16).collect()}
    vals = defaultdict(list)
    for k, _, text, *_ in ROWS:
        if text is not None:
            vals[k].append(len(text))
    for k, v in vals.items():
        v.sort()
        for p in (0.0, 0.5, 1.0):
            assert got[(k, p)] == v[max(1, math.ceil(p * len(v))) - 1]
    assert (None, 0.5) not in got


def test_hot_empty(spark):
    df = _hot(spark, [])
    assert hotkeys.per_key(df, "k", "item", "text", "day").count() == 0
    assert hotkeys.hot_keys(hotkeys.per_key(df, "k", "item", "text", "day")).count() == 0
    assert hotkeys.quantiles(df, "k", F.length("text"), [0.5]).count() == 0


def test_near_duplicates_equal_sequential(spark):
    base = ["wach rakoum khouti lyoum rani mlih hadi bezzaf hehe", "je pense que le match de ce soir est très important", "quiet river under the old green bridge was flowing"]
    rows = [(i, base[i % 3] + (" haha" if i % 5 == 0 else "") + (f" {i}" if i % 4 == 0 else "")) for i in range(40)] + [(100, None), (101, ""), (102, base[0])]
    got = {r.id: r.kept for r in neardup.keep_first(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()}
    seen, want = set(), {}
    for i, t in rows:
        sig = neardup.minhash(t)
        keys = {(b, tuple(sig[b * 13 : b * 13 + 13])) for b in range(9)} if sig else set()
        want[i] = not (keys & seen)
        if want[i]:
            seen |= keys
    assert got == want


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([(1, "a b c a b d".split()), (2, "a b c c d".split()), (3, []), (4, None)], "id int, w array<string>")
    m = ngram.kneser_ney(df, "w")
    p3 = m["p3"].collect()
    b3 = {(r.w1, r.w2): r.b for r in m["b3"].collect()}
    p2 = {(r.w2, r.w3): r.p for r in m["p2"].collect()}
    p1 = {r.w3: r.p for r in m["p1"].collect()}
    b2 = {r.w2: r.b for r in m["b2"].collect()}
    p0 = m["p0"].first().p
    assert abs(sum(p1.values()) + p0 - 1) < 1e-9
    words = set(p1)
    for ctx in b3:
        seen = {r.w3: r.p for r in p3 if (r.w1, r.w2) == ctx}
        low = lambda w: p2.get((ctx[1], w), b2[ctx[1]] * p1[w])
        total = sum(seen.get(w, b3[ctx] * low(w)) for w in words) + b3[ctx] * b2[ctx[1]] * p0
        assert abs(total - 1) < 1e-9
    s = ngram.perplexity(m, df.filter("w is not null").withColumn("g", F.lit("x")), "id", "w", "g").first()
    assert s.perplexity_per_word > 1 and s.oov_token_rate == 0


def test_sampling(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else None) for i in range(100)], "id bigint, s string")
    assert Counter(r.s for r in sampling.reservoir(df, "id", "s", 20, 1).collect()) == {"a": 20, None: 10}
    assert sampling.stratified_fraction(df, "id", "s", 0.2, 1).count() == 20
    parts = Counter((r.s, r.part) for r in sampling.split(df, "id", "s", 8, 1).collect())
    assert parts[("a", "dev")] == parts[("a", "test")] == 4 and parts[(None, "train")] == 2
    assert sampling.reservoir(df.limit(0), "id", "s", 3, 1).count() == 0


def test_crawl(spark):
    tree = spark.createDataFrame([("r", "R", None, "c", False), ("x", "X", "r", "z", True), ("y", "Y", "x", "z", False), ("w", "W", "r", None, None)], "forum_id string, title string, parent_id string, category_id string, is_private boolean")
    got = {r.forum_id: (r.category_id, r.depth) for r in crawl.reachable(tree).collect()}
    assert got == {"r": ("c", 0), "x": ("c", 1), "w": ("c", 1)}
    old, new = spark.createDataFrame([("a", "t", "d")], "k string, t string, d string"), spark.createDataFrame([("a", "", "e"), ("b", "u", None)], "k string, t string, d string")
    assert {tuple(r) for r in crawl.merge_state(old, new, "k").collect()} == {("a", "t", "e"), ("b", "u", None)}


def test_html():
    page = '<a id="thread_title_t1" href="#"><b>Thread One</b></a><div class="pagenav"><a rel="next">n</a></div><table id="post1"><tr><td class="thead">2020-01-01, 00:00</td></tr><a class="bigusername">u</a><div id="post_message_1"> hi <br> there </div></table><table id="postx"></table>'
    assert html.threads(page) == [("t1", "Thread One")] and html.has_next(page)
    assert html.posts(page) == [("1", "u", "2020-01-01, 00:00", "hi\nthere")]
    assert html.posts(None) == [] and not html.has_next("")


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","text":"x"}\n{broken\n{"id":"","text":"y"}\n{"id":"2","text":null}\n')
    schema = records._strings("id", "text")
    assert [r.id for r in records.tolerant_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()] == ["1"]
    (tmp_path / "t.conllu").write_text("# sent_id = s1\n# text = a b\n1\ta\t_\tlang=FR\n1-2\tab\t_\n2\tb\t_\tlang=FR\n\n# sent_id = s2\n# text = c\n1\tc\t_\tlang=AR\n")
    got = {r.sent_id: (r.text, r.tokens, r.lang_tags) for r in records.conllu(spark, str(tmp_path / "t.conllu")).collect()}
    assert got == {"s1": ("a b", 2, {"FR": 2}), "s2": ("c", 1, {"AR": 1})}
    (tmp_path / "l.tsv").write_text("id\tlabel\n# sent_id = s1\tpos\n# sent_id = s1\tneg\n")
    assert [tuple(r) for r in records.sentence_labels(spark, str(tmp_path / "l.tsv")).collect()] == [("s1", "neg")]
    (tmp_path / "c.csv").write_text('pos,"a, b"\nneg,c\nnothing\n')
    assert {tuple(r) for r in records.label_text(spark, str(tmp_path / "c.csv")).collect()} == {("pos", "a, b"), ("neg", "c")}


def test_stream_runs_once(spark, tmp_path):
    raw, out = tmp_path / "raw", f"file://{tmp_path}/out"
    raw.mkdir()

    def put(name, texts):
        lines = [json.dumps({"comment_id": f"{name}{k}", "text": t, "video_id": "v", "source_type": "comment"}) for k, t in enumerate(texts)]
        (raw / name).write_text("\n".join(lines))

    put("a.json", ["mazal ma jawch khouya, rahom f trig والله؟؟؟؟؟؟", "mazal ma jawch khouya, rahom f trig والله؟؟", "😂😂😂"])
    incremental.run(spark, f"file://{raw}", out)
    log = incremental.run_log(spark, out).first()
    assert (log.collected, log.dropped_empty, log.retained) == (3, 1, 1)
    incremental.run(spark, f"file://{raw}", out)
    assert incremental.run_log(spark, out).first().collected == 3
    put("b.json", ["mazal ma jawch khouya, rahom f trig والله؟؟؟", "un tout autre message sur le marché du village"])
    incremental.run(spark, f"file://{raw}", out)
    log = incremental.run_log(spark, out).first()
    assert (log.collected, log.retained) == (5, 2)
