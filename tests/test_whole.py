"""The whole job is done: no rows, candidates or keys are cut."""

import json

import numpy as np
from pyspark.sql import functions as F

from warraq.operators import embeddings
from warraq.plans import evaluation
from warraq.sources import records
from warraq.streaming import incremental


def _vec_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def _brute(pairs, vecs, pool, top):
    """Of the questions of pairs (a, b): (asked, skipped, right)."""
    n = skipped = right = 0
    for i, (a1, b1) in enumerate(pairs):
        for j, (a2, b2) in enumerate(pairs):
            if i == j:
                continue
            cand = [x for x in sorted(pool) if x not in (a1, b1, a2)]
            if any(x not in vecs for x in (a1, b1, a2)) or not cand:
                skipped += 1
                continue
            t = vecs[b1] - vecs[a1] + vecs[a2]
            cos = [float(vecs[x] @ t) / (np.linalg.norm(vecs[x]) * np.linalg.norm(t) or 1) for x in cand]
            n += 1
            right += b2 in [x for _, x in sorted(zip([-round(c, 9) for c in cos], cand, strict=True))[:top]]
    return n, skipped, right


def test_analogies_all_rows_all_vectors(spark, tmp_path, monkeypatch):
    # Small blocks, so that questions and candidates meet in several groups.
    monkeypatch.setattr(embeddings, "PAIRS", 5)
    monkeypatch.setattr(embeddings, "CANDIDATES", 17)
    r = np.random.RandomState(3)
    rows = []
    for k in range(82):
        label = k % 2
        base = r.normal(size=4)
        rows.append((k, [float(x) for x in np.float32(base)], label))
    # Pairs of label 0 that differ by about the same step.
    ids = [k for k in range(82) if k % 2 == 0]
    for a, b in zip(ids[0::2], ids[1::2]):
        rows[b] = (b, [float(x) for x in np.float32(np.array(rows[a][1]) + [2, 0, 1, 0] + 0.05 * r.normal(size=4))], 0)
    got = {x.category: x for x in evaluation.analogy_accuracy(spark, _vec_table(spark, tmp_path, rows)).collect()}
    vecs = {k: np.array(v, dtype=np.float64) for k, v, _ in rows}
    for label in (0, 1):
        own = [k for k, _, x in rows if x == label]
        n, skipped, right = _brute(list(zip(own[0::2], own[1::2])), vecs, vecs, 1)
        x = got[str(label)]
        assert (x.n, x.skipped, round(x.accuracy * x.n)) == (n, skipped, right)
        assert n == 20 * 19
    assert got["0"].accuracy > 0.3


def test_analogies_pool_skipped_ties(spark):
    r = np.random.RandomState(4)
    vecs = {k: r.normal(size=3) for k in range(30)}
    vecs[7] = vecs[3].copy()  # equal vectors: the smaller id is nearer
    vecs[11] = np.zeros(3)
    pairs = [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11), (50, 12), (13, 51), (2, 7), (14, 14)]
    df = spark.createDataFrame([("c", k, a, b) for k, (a, b) in enumerate(pairs)] + [("none", 0, 60, 61), ("none", 1, 62, 63)], "category string, pos int, a bigint, b bigint")
    v = spark.createDataFrame([(k, x.tolist()) for k, x in vecs.items()] + [(51, None)], "id bigint, vec array<double>")
    words = {x for p in pairs for x in p if x in vecs}
    for pool, top in ((None, 1), (None, 4), (words, 1), (words, 3), ({3, 7}, 1), ({3}, 1)):
        sent = None if pool is None else spark.createDataFrame([(x,) for x in pool], "id bigint")
        got = {x.category: x for x in embeddings.analogies(df, v, top, sent).collect()}
        n, skipped, right = _brute(pairs, vecs, vecs if pool is None else pool, top)
        assert (got["c"].n, got["c"].skipped, round((got["c"].accuracy or 0) * got["c"].n)) == (n, skipped, right)
        assert (got["none"].n, got["none"].skipped, got["none"].accuracy) == (0, 2, None)


def _lines(path, rows):
    path.write_text("\n".join(json.dumps({"comment_id": i, "text": t, "video_id": "v", "source_type": "comment"}) for i, t in rows))


TEXTS = [
    "mazal ma jawch khouya, rahom f trig hadi chhal",
    "un tout autre message sur le marché du village",
    "quiet river under the old green bridge was flowing",
    "wach rakoum khouti lyoum rani mlih bezzaf hehe",
    "je pense que le match de ce soir est très important",
    "nchallah ghodwa nrouhou lel bhar m3a drari kamel",
]


def test_stream_keeps_null_and_repeated_ids(spark, tmp_path):
    raw, out = tmp_path / "raw", f"file://{tmp_path}/out"
    raw.mkdir()
    # Null ids, and one id with two texts: six texts that aren't near each other.
    _lines(raw / "a.json", [(None, TEXTS[0]), (None, TEXTS[1]), (None, TEXTS[2]), ("x", TEXTS[3]), ("x", TEXTS[4]), ("y", TEXTS[5]), ("z", TEXTS[5])])
    incremental.run(spark, f"file://{raw}", out)
    log = incremental.run_log(spark, out).first()
    assert (log.collected, log.dropped_empty, log.dropped_repeats, log.retained) == (7, 0, 1, 6)
    assert {r.text for r in spark.read.parquet(f"{out}/docs").collect()} == set(TEXTS)


def test_stream_keeps_the_first_to_arrive(spark, tmp_path):
    raw, out = tmp_path / "raw", f"file://{tmp_path}/out"
    raw.mkdir()
    # The same six texts in three files, under other ids: those of the first file, by name, stay, and in their order.
    for name in ("c", "a", "b"):
        _lines(raw / f"{name}.json", [(f"{name}{9 - k}", t) for k, t in enumerate(TEXTS)] + [(f"{name}again", TEXTS[0])])
    incremental.run(spark, f"file://{raw}", out)
    got = [(r.comment_id, r.text) for r in spark.read.parquet(f"{out}/docs").orderBy("id").collect()]
    assert got == [(f"a{9 - k}", t) for k, t in enumerate(TEXTS)]
    log = incremental.run_log(spark, out).first()
    assert (log.collected, log.dropped_repeats, log.retained) == (21, 15, 6)


def test_rows_are_numbered_by_file_and_line_over_blocks(spark, tmp_path):
    for name, n in (("b", 300), ("a", 200)):
        _lines(tmp_path / f"{name}.json", [(f"{name}{k}", "t" * (k % 50)) for k in range(n)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = spark.read.schema(records.RAW_COMMENT).json(str(tmp_path)).withColumn("path", F.col("_metadata.file_path")).withColumn("block", F.col("_metadata.file_block_start"))
        assert df.select("path", "block").distinct().count() > 5
        rows = incremental.numbered(df, 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    ids = [r.comment_id for r in sorted(rows, key=lambda r: r.id)]
    assert ids == [f"a{k}" for k in range(200)] + [f"b{k}" for k in range(300)]
    assert sorted(r.id - (2 << 40) for r in rows) == list(range(500))
