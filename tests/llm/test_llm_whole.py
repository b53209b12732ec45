"""The whole job is done: nothing that a pattern or a model accepts is passed over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.llm import history, pii, residue

ADDRESSES = [
    *(f"rdv au {before} {way} des Pins, Oran" for before in ("12", "12,", "12 bis", "lot n° 12") for way in ("rue", "avenue", "av", "av.", "bd", "boulevard", "chemin", "route", "impasse", "place", "allée", "allee", "ALLÉE", "quai")),
    *(f"he lives at 24 Baker {road} London" for road in ("Street", "Road", "avenue", "lane", "st.", "rd.", "St.")),
    *(f"{hay} 500 {homes} {block} 12 bab 4 Oran" for hay in ("hay", "7ay") for homes in ("sakan", "maskan", "logt", "logts") for block in ("3imara", "imara", "bat", "bt")),
    "cité 200 logts bat 3 n° 12 Oran", "cite 200 logements bloc 3 porte 12 Oran", "building 4, flat 12, Oran", "Block B, apt. 3, Oran",
    "حي 500 مسكن عمارة 12 رقم 4 وهران", "عمارة 12 باب 4 حي السلام وهران", "شارع الاستقلال رقم 12 وهران", "12 نهج الاستقلال، وهران",
]
EMAILS = ["amine.k@mail.com", "amine.k＠mail.com", *(f"amine.k [{at}] mail [{dot}] com" for at in ("at", "arobas", "arobase", "AT", "@") for dot in ("dot", "point", ".")), "amine.k at mail dot com", "amine.k arobase mail point com"]


@pytest.mark.parametrize("text", ADDRESSES)
def test_addresses_pass_their_hint(text):
    assert any(p.search(text) for p in pii._ADDRESS)
    assert "address" in {s.kind for s in pii.Finder([]).spans(text)}


@pytest.mark.parametrize("text", EMAILS)
def test_emails_pass_their_hint(text):
    assert pii._EMAIL.search(text)
    assert "email" in {s.kind for s in pii.Finder([]).spans(text)}


def test_residue_of_two_kinds_is_covered_by_both():
    # Wholly residue, half notices and half filler: neither kind alone covers enough.
    prose = ["je pense que le match de ce soir est très important", "quiet river under the old green bridge was flowing", "wach rakoum khouti lyoum rani mlih hadi bezzaf hehe"]
    judge = residue.Judge(residue.fit(prose))
    notices = [x for x in residue.NOTICES if x]
    for k in range(0, 40, 4):
        note = " ".join(notices[k : k + 4])
        assert judge.is_residue(f"{note} {residue.filler_seed(400, 100 + k)[: len(note)]}")
    assert not any(judge.is_residue(p) for p in prose)


def test_natural_model_has_every_sample(spark):
    # The last texts in order count like the first, whatever their number.
    texts = [f"matin calme numéro {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(5200)] + ["zebra wordless xylophone", "", "  ", None]
    got = residue.fit(residue.read_prose(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)))
    assert (got == residue.fit([t for t in texts if t])).sum() == (~np.isnan(got)).sum()
    assert (~np.isnan(got)).sum() > (~np.isnan(residue.fit(texts[:5000]))).sum()
    none = residue.read_prose(spark.createDataFrame([(None,)], "text string"))
    assert not none.any() and np.array_equal(residue.fit(none), residue.fit([]), equal_nan=True)


def _entry(route, label, ord_, n=100):
    return (route, label, ord_, n)


def test_pairs_are_verified_well_below_the_usual_agreement(spark):
    # 64 of 80 functions agree on average at the threshold, 50 and 46 are let through; four bits each, sixteen to a word.
    def words(differ):
        return [x - (1 << 64) if (x := sum(((16 * w + k) < differ) << (4 * k + 3) for k in range(16))) >> 63 else x for w in range(5)]

    # Two long texts: of 144 functions and smallest hashes, 91 are let through.
    low = list(range(64))
    half = [x + 1000 * (x >= 40) for x in low]  # the 64 smallest of either hold 40 of both
    rows = [(0, words(0), []), (1, words(30), []), (2, words(34), []), (3, words(35), []), (4, words(0), low), (5, words(29), half), (6, words(30), half)]
    df = spark.createDataFrame(rows, "ord bigint, fours array<bigint>, bottom array<int>")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (5, 4), (6, 4), (5, 0)], "dup bigint, kept bigint")
    assert {tuple(r) for r in history.alike(pairs, df, df).collect()} == {(1, 0), (2, 0), (5, 4), (5, 0)}


def test_unlike_long_texts_end_where_they_meet(spark):
    # Same range, same size: 45 of 80 functions agree for one, 46 for another; short texts carry no signatures.
    def words(differ):
        return [x - (1 << 64) if (x := sum(((16 * w + k) < differ) << (4 * k + 3) for k in range(16))) >> 63 else x for w in range(5)]

    rows = [(7, 7 << 32, 0, 900, words(0)), (7, 7 << 32, 1, 900, words(34)), (7, 7 << 32, 2, 900, words(35)), (7, 7 << 32, 3, 900, None)]
    df = spark.createDataFrame(rows, "route bigint, label bigint, ord bigint, n int, fours array<bigint>")
    asked = history.lookups(df, 5)
    got = lambda x: {tuple(r) for r in x.filter("kept = 0").collect()}
    for exact, want in ((False, {(1, 0), (3, 0)}), (True, {(1, 0), (2, 0), (3, 0)})):
        assert got(history.candidates(asked, df, 5, exact=exact)) == want
        assert got(history.meetings(asked, asked, exact=exact)) == want


def test_pairs_of_unlike_long_texts_are_not_stored(spark, monkeypatch):
    import random

    from test_llm import _brute, _frame, _pairs

    # Long texts of few words resemble each other, though none repeats another but the one copy with a word changed.
    r = random.Random(5)
    some = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(260)]
    rows = [(int(k >= 100), k, " ".join(r.choices(some, k=250))) for k in range(200)]
    rows.append((1, 200, rows[3][2] + " more"))
    forest = history.build(spark, _frame(spark, [x for x in rows if x[0] == 0]))
    pairs, real = [], history._Steps.__call__
    monkeypatch.setattr(history._Steps, "__call__", lambda self, df: (lambda t: (pairs.append(t.count()) if t.columns == ["dup", "kept"] else None, t)[1])(real(self, df)))
    new = _frame(spark, [x for x in rows if x[0] == 1])
    assert _pairs(history.admit(forest, new, commit=False, exact=True)) == {(3, 200)}
    met = sum(pairs)
    pairs.clear()
    got = _pairs(history.admit(forest, new))
    # The run's entries are sent without the head of the label, and read as they were.
    e = spark.table(forest.name)
    assert e.filter(f"(route & {(1 << 24) - 1}) <> shiftright(label, 32) or n < {history.LONG} or size(fours) <> 5").isEmpty()
    signed = history.sign(new)
    assert {(x.ord, x.label, x.n) for x in e.filter("run = 1").collect()} == {(x.ord, x.label, x.n) for x in history._entries(signed).collect()}
    forest.drop()
    assert got == _brute(rows) == {(3, 200)}
    assert met > 1000 and sum(pairs) < 0.2 * met


def test_exact_look_up_gives_the_same(spark):
    from test_llm import _brute, _frame, _history_rows, _pairs

    rows, _ = _history_rows()
    forest = history.build(spark, _frame(spark, [r for r in rows if r[0] == 0]))
    assert _pairs(history.admit(forest, _frame(spark, [r for r in rows if r[0]]), commit=False, exact=True)) == _brute(rows)
    forest.drop()


def test_prefixes_are_widened_until_the_target_is_reached(spark):
    assert history.depth_for(0.9) > history.depth_for(0.995) > history.depth_for(0.9999) >= history.HEAD
    with pytest.raises(ValueError, match="recall"):
        history.depth_for(1 - 1e-12)
    # Labels of seven bytes that share 6, 5, 4 and 3 bytes with the first.
    base = 0x01020304050607
    df = spark.createDataFrame([_entry(base >> 32, x, k) for k, x in enumerate((base, base ^ 1, base ^ (1 << 9), base ^ (1 << 17), base ^ (1 << 25)))], history._ENTRY)
    met = {d: {r.dup for r in history.candidates(history.lookups(df, d), df, d).filter("kept = 0").collect()} for d in (7, 6, 5, 4, 3)}
    assert met == {7: set(), 6: {1}, 5: {1, 2}, 4: {1, 2, 3}, 3: {1, 2, 3, 4}}


def test_ids_out_of_range_are_an_error(spark):
    for no, i in ((0, 1 << 44), (0, -1), (4096, 1), (-1, 1)):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(no, i)], "b int, i bigint").select(history.order_of(0, F.col("b"), F.col("i")).alias("o")).collect()
    df = spark.createDataFrame([(None, 1), (1, None), (3, 7)], "b int, i bigint").select(history.order_of(1, F.col("b"), F.col("i")).alias("o"))
    assert [r.o for r in df.collect()] == [None, None, (1 << 56) | (3 << 44) | 7]
    assert df.select(history.batch_of(F.col("o")).alias("b"), history.row_of(F.col("o")).alias("i")).collect()[2] == (3, 7)
