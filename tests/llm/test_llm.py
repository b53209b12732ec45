"""Training-data operators against brute force, libraries and round trips, with the defined edge cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from warraq.llm import bpe, history, language, mixing, pii, queries, residue, splitting, terms, tokens
from warraq.operators.tokenizers import load

NOISE = "abcdefgh THE theing's\n\t 123سلام كم😀é-_=<|endoftext|>[CLS]"


def noise(n, seed=1, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(NOISE) for _ in range(r.randint(0, longest))) for _ in range(n)]


def docs(spark, texts, **extra):
    """Rows with columns named like the operators' own."""
    rows = [(i, t, "ids", 1, "prefix") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, term string, ord int, prefix string")


EDGE = [None, "", " ", "a", "a", "é" * 5000, "<|endoftext|>", "x y " * 3000]


# --- 5 and 8 ----------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_ids_and_counts_are_exact(name):
    encode, _ = load(name)
    path = bpe.rank_path(name)
    e, c = bpe.encoder(path), bpe.counter(path)
    for t in [*noise(2000), *[x for x in EDGE if x]]:
        want = encode(t)
        assert e.encode(t) == want
        assert c.count(t) == len(want)
    assert e.encode(None) == [] and c.count("") == 0


def test_perfect_hash():
    words = [f"w{i}".encode() for i in range(2000)]
    h = bpe.PerfectHash(words)
    assert [h.get(w) for w in words] == list(range(2000)) and sorted(h.slot) == list(range(2000))
    assert h.get(b"none") == -1


def test_encode_frame(spark):
    encode, _ = load("byte_bpe_50k")
    got = {r.doc_id: r.ids for r in tokens.encode(docs(spark, EDGE), "doc_id", "text").collect()}
    assert got == {i: encode(t) if t else [] for i, t in enumerate(EDGE)}
    assert tokens.encode(docs(spark, []), "doc_id", "text").count() == 0


def test_token_budget(spark):
    encode, _ = load("byte_bpe_50k")
    rows = [("a", "x", "hello there"), ("a", None, None), (None, "x", ""), ("a", "x", "hi"), (None, None, "yes")]
    df = spark.createDataFrame(rows, "source string, lang string, text string")
    got = {(r.level, r.source, r.lang): (r.records, r.null_texts, r.empty_texts, r.tokens) for r in tokens.token_budget(df, ["source", "lang"]).collect()}
    n = lambda *ts: sum(len(encode(t)) for t in ts)
    assert got[("source,lang", "a", "x")] == (2, 0, 0, n("hello there", "hi"))
    assert got[("source", None, None)] == (2, 0, 1, n("yes"))
    assert got[("lang", None, None)] == (2, 1, 0, n("yes"))
    assert got[("", None, None)] == (5, 1, 1, n("hello there", "hi", "yes"))
    assert tokens.token_budget(df.limit(0), ["source", "lang"]).count() == 0


# --- 10 ---------------------------------------------------------------------


def _texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeسلامكم") for _ in range(r.randint(1, 9)))
    para = lambda: " ".join(word() + r.choice(["", "", ".", ",", "!"]) for _ in range(r.randint(5, 120)))
    out = [r.choice(["\n\n", "\r\n", "\n"]).join(para() for _ in range(r.randint(1, 12))) for _ in range(60)]
    return out + ["سلام" * 2000, "a" * 9000, "😀" * 3000, "  \n\n  " * 900, "x y'" * 800, *noise(30, 2, 3000)]


def test_split_guarantees():
    e = bpe.encoder(bpe.rank_path("byte_bpe_50k"))
    s = splitting.Splitter(e)
    limits = [(64, 8), (200, 0), (500, 64)]
    for t in _texts():
        n = len(e.encode(t))
        for (most, overlap), pieces in zip(limits, s.split(t, limits)):
            assert bool(pieces) == (n > most)
            if pieces:
                assert "".join(t[b:c] for _, b, c, _ in pieces) == t
            for k, (a, b, c, count) in enumerate(pieces):
                assert count == len(e.encode(t[a:c])) <= most
                assert a == b or k > 0


def test_split_prefers_strong_boundaries():
    s = splitting.Splitter(bpe.encoder(bpe.rank_path("byte_bpe_50k")))
    t = "one two three four five. " * 8 + "\n\n" + "six seven eight nine ten. " * 8
    (pieces,) = s.split(t, [(60, 0)])
    assert t[: pieces[0][2]].endswith("\n\n") or any(t[:c].endswith("\n\n") for _, _, c, _ in pieces)


def test_split_frame(spark):
    df = docs(spark, EDGE)
    got = splitting.split(df, [("s", 100, 10)]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.doc_id for r in got} == {5, 7}
    kept = splitting.split(df, [("s", 100, 10)], keep_short=True)
    assert {r.doc_id for r in kept.select("doc_id").distinct().collect()} == set(range(len(EDGE)))
    assert splitting.split(df.limit(0), [("s", 100, 10)]).count() == 0


# --- 9 ----------------------------------------------------------------------


def test_mix(spark):
    rows = [(i, "big" if i < 300 else "small", "word " * (i % 17 + 3)) for i in range(340)] + [(900, "big", None), (901, "other", "x"), (902, None, "x"), (903, "small", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, goals)
    got = m.documents.collect()
    assert {r.source for r in got} <= {"big", "small"} and all(r.copies <= (1 if r.source == "big" else 3) for r in got)
    assert len({r.doc_id for r in got}) == len(got) and not {900, 901, 902, 903} & {r.doc_id for r in got}
    shares = {r.source: r for r in m.shares.collect()}
    assert abs(shares["big"].reached_share - 0.6) < 0.01 and shares["absent"].mixed_tokens == 0
    # All of the scarcer source is used before any of it is used more often.
    small = [r.copies for r in got if r.source == "small"]
    assert max(small) - min(small) <= 1
    assert mixing.mix(df.limit(0), goals).documents.count() == 0
    half = {r.source: r.mixed_tokens for r in mixing.mix(df, goals, total_tokens=500).shares.collect()}
    assert abs(half["big"] - 300) <= 20 and abs(half["small"] - 200) <= 20


# --- 4 ----------------------------------------------------------------------


def test_terms(spark):
    texts = [*EDGE, "The the THE fox_1 ٣٤ 12 a12", "fox_1 کلمه ²", "zz" * 40]
    occ, rec = Counter(), Counter()
    for t in texts:
        found = terms.terms_of(t or "")
        occ.update(found)
        rec.update(set(found))
    got = {r.term: (r.occurrences, r.records) for r in terms.frequencies(docs(spark, texts)).collect()}
    assert got == {t: (occ[t], rec[t]) for t in occ}
    assert terms.frequencies(docs(spark, [])).count() == 0


def test_trie_bursts_and_routes():
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(4000)]
    trie = terms.BurstTrie(limit=8)
    want = Counter()
    for w in words:
        trie.add(w, 2, 1)
        want[w] += 1
    got = {p + s: (o, n) for p, box in trie.containers() for s, o, n in terms.unpack(terms.pack(box))}
    assert got == {w: (2 * n, n) for w, n in want.items()} and trie.size == len(want)
    router = terms.Router({"", "a", "ab", "abc"})
    for p, box in trie.containers():
        for route, part in router.cut(p, box):
            assert all(router.route(t) == route for t, _, _ in part)


# --- 1 ----------------------------------------------------------------------

NAMES = ["Kirza", "كيرزا", "Loubo"]
CASES = [
    ("راسلوني على foo_bar [at] boite [dot] example", {"email"}),
    ("FOO.BAR＠POSTE.INVALID", {"email"}),
    ("salut @ahmed.dz merci @lol", set()),
    ("رقمي ٠٥.٠٦.٢٦.٤٥.٢٨ واتساب", {"phone"}),
    ("num ta3i (+213) 508 865210", {"phone"}),
    ("colis 90584509895 réf 88-88-88 prix 7234 da 517 517 vues 12:30", set()),
    ("3andi NIN ta3i : 164-634602-520447-609", {"id_number"}),
    ("passport number: X07184456", {"id_number"}),
    ("j'habite cité 70 logements, bât. 182, porte n° 154, Djebel Ounissa", {"address"}),
    ("نسكن في 46 شارع سوق الصوف، برج سلوك", {"address"}),
    ("la rue est vide", set()),
    ("الشارع راه خالي", set()),
    ("اسمي كِيرزا ولد زاهلوي", {"person_name"}),
    ("bravo Kirza !", set()),
    ("يا كيرزا الله يحفظك", set()),
    ("salam m3a OULD ZAHELOUI Loubo khouya", {"person_name"}),
    ("kirza.bounaleboui@poste.invalid", {"email"}),
    (None, set()),
    ("", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_pii(text, want):
    assert {s.kind for s in pii.Finder(NAMES).spans(text)} == want


def test_pii_frame(spark):
    df = docs(spark, [c[0] for c in CASES] + ["mail x@y.example et x@y.example " + "z " * 20000])
    got = {(r.rec_id, r.kind) for r in pii.kinds(df, "doc_id", "text", NAMES).collect()}
    assert got == {(i, k) for i, (_, w) in enumerate(CASES) for k in w} | {(len(CASES), "email")}
    red = {r.doc_id: r.r for r in df.select("doc_id", pii.redact(F.col("text"), NAMES).alias("r")).collect()}
    assert red[1] == "[EMAIL]" and red[2] == CASES[2][0] and red[len(CASES)].startswith("mail [EMAIL] et [EMAIL] z")
    assert pii.find(df.limit(0), "doc_id", "text", NAMES).count() == 0


def test_validators():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97("3214282912345698765432161182") and not pii.mod97("3214282912345698765432161183")
    assert pii.dialable("+213 6 07 363 636") and not pii.dialable("90584509895")


# Published test numbers; with one digit changed they are nothing.
KEYED = ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "DE89370400440532013000", "1 84 12 76 451 089 46"]


@pytest.mark.parametrize("number", KEYED)
def test_a_changed_digit_changes_the_decision(number, monkeypatch):
    finder = pii.Finder(NAMES)
    kinds = lambda t: {s.kind for s in finder.spans(t)}
    assert kinds(f"voila {number} merci") == {"id_number"}
    for k in [k for k, c in enumerate(number) if c.isdigit()][-3:]:
        wrong = number[:k] + str((int(number[k]) + 1) % 10) + number[k + 1 :]
        assert kinds(f"voila {wrong} merci") == set()
    assert kinds(f"colis {number} prix") == set() or number[0].isalpha()
    for name in ("luhn", "iban", "keyed"):
        monkeypatch.setattr(pii, name, lambda _: False)
    assert kinds(f"voila {number} merci") == set()


@pytest.mark.parametrize("text", ["+33 6 12 34 56 78", "appelle 0044 20 7946 0958", "tel +1 (212) 555-0147", "+216 20 123 456"])
def test_phones_abroad(text):
    assert {s.kind for s in pii.Finder(NAMES).spans(text)} == {"phone"}


# --- 3 and 7 ----------------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark, sf):
    return spark.read.parquet(f"{sf}/lang_samples.parquet")


def test_residue(spark, samples):
    ratios = residue.fit(residue.read_prose(samples))
    judge = residue.Judge(ratios)
    yes = ["Bonjour {{prenom}} merci", "x ${user.name} y", "رمز الخطأ 404 - انتهت مهلة الطلب", "please enable JavaScript to continue", residue.filler_seed(60, 9), "a | b | c | d | 503 could not render this view go back home | e | f"]
    no = [None, "", " ", "{{ }} {}", "[b]x[/b] [URL] __init__.py", "100% d'accord 5% x", "هاد الزنقة مازال حنا البارح خرجلي خطأ 404 كي حليت الموقع نهدرو بزاف على هاد القعدة"]
    assert [judge.is_residue(t) for t in yes] == [True] * len(yes)
    assert [judge.is_residue(t) for t in no] == [False] * len(no)
    df = docs(spark, yes + no)
    assert {r.rec_id for r in residue.flag(df, "doc_id", "text", ratios).collect()} == set(range(len(yes)))
    assert residue.exclude(df, "text", ratios).count() == len(no) and residue.exclude(df, "text", ratios).columns == df.columns
    assert residue.flag(df.limit(0), "doc_id", "text", ratios).count() == 0


def test_residue_held_out(samples):
    import heldout_residue as held

    judge = residue.Judge(residue.fit(residue.read_prose(samples)))
    seeds = {x.lower() for x in residue.NOTICES}
    assert not [x for x in held.NOTICES if x.lower() in seeds]
    # Thresholds were chosen on the even lines; the odd ones were not used for them.
    for part in (slice(0, None, 2), slice(1, None, 2)):
        cases, left = [*held.NOTICES[part], *held.FILLER[part]], held.MESSAGES[part]
        right, wrong = sum(map(judge.is_residue, cases)), sum(map(judge.is_residue, left))
        assert right >= 0.9 * len(cases) and right >= 0.95 * (right + wrong)


def test_long_prose_that_repeats_its_words_is_no_filler():
    words = "river bridge morning quiet garden letter window summer brother village".split()
    r = random.Random(2)
    assert not residue.meaningless(" ".join(r.choice(words) for _ in range(5000)))
    assert residue.meaningless("wham wham wham wham") and residue.meaningless("zzzz xxx") and not residue.meaningless("hhhhh hhhhh hhhhh hhhhh hh")


def test_language_held_out(samples):
    rows = language.read_samples(samples)
    train, held = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if k % 4 == 0]
    who = language.Identifier(language.fit(train))
    long = [(lang, t) for lang, t in held if len(t.split()) >= 5]
    right = sum(who.text(t)[0] == lang for lang, t in long)
    assert right >= 0.97 * len(long)
    assert who.text(None) == (None, 0.0) and who.text("12 :) ")[0] is None


def test_labels_and_segments(spark, samples):
    assert [language.named(x) for x in ("ARQ-Arab", " fra", "fr-DZ", "en_US", "und", "??", "", None, "mul")] == ["arq_arab", "fra", "fra", "eng", None, None, None, None, "mul"]
    rows = dict(language.read_samples(samples))
    profiles = language.fit(language.read_samples(samples))
    mixed = f"{rows['fra']}\r\n\n{rows['arq_latn']}\n{rows['fra']}"
    df = docs(spark, [rows["fra"], mixed, None, "", rows["eng"], rows["eng"]]).withColumn("label", F.element_at(F.array(*[F.lit(x) for x in ("fr-FR", "fra", "fra", "fra", "", "eng")]), (F.col("doc_id") + 1).cast("int")))
    got = {(r.rec_id, r.seg_no): r.lang for r in language.relabelled(df, "doc_id", "text", "label", profiles).collect()}
    assert got == {(1, 0): "mul", (1, 1): "fra", (1, 2): "arq_latn", (1, 3): "fra", (4, 0): "eng"}
    assert language.segments(df.limit(0), "doc_id", "text", profiles).count() == 0


# --- 2 ----------------------------------------------------------------------


def _history_rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    base = [" ".join(word() for _ in range(r.randint(14, 40))) for _ in range(40)]
    rows, i = [], 0
    for batch in range(4):
        for _ in range(60):
            t = r.choice(base)
            if r.random() < 0.7:
                w = t.split()
                for _ in range(r.randint(1, max(1, len(w) // 7))):
                    w[r.randrange(len(w))] = word()
                t = " ".join(w)
            rows.append((batch, i, r.choice([t, t, t.upper(), t + " @someone", "short text", None, ""])))
            i += 1
    # A third of all rows are one text.
    rows += [(b, 1000 + 200 * b + k, base[0]) for b in range(4) for k in range(40)]
    return sorted(rows), base


def _brute(rows):
    n = history.normal([t for *_, t in rows], [False] * len(rows))
    accepted, out = [], set()
    for (batch, i, _), t in zip(rows, n):
        if t is None:
            continue
        s, hit = history.shingles(t), None
        if batch:
            hit = next((j for j, o in accepted if len(s & o) >= 0.8 * len(s | o)), None)
        if hit is None:
            accepted.append((i, s))
        else:
            out.add((hit, i))
    return out


def test_history_one_delivery_and_many(spark):
    rows, _ = _history_rows()
    want = _brute(rows)
    df = spark.createDataFrame(rows, "batch int, i bigint, text string").select(history.order_of(3, F.col("batch"), F.col("i")).alias("ord"), F.lit(False).alias("post"), "text", F.lit(1).alias("n"))
    batch = lambda c: F.shiftrightunsigned(c, 44).bitwiseAND(F.lit(4095))
    pair = lambda x: {(r.k, r.d) for r in x.select(history.row_of(F.col("kept")).alias("k"), history.row_of(F.col("dup")).alias("d")).collect()}
    forest = history.build(spark, df.filter(batch(F.col("ord")) == 0))
    assert pair(history.admit(forest, df, lambda c: batch(c) > 0, commit=False)) == want
    got = set()
    for no in (1, 2, 3):
        # Delivery by delivery; each one's accepted texts join the forest.
        upto = df.filter(batch(F.col("ord")) <= no)
        got |= pair(history.admit(forest, upto, lambda c, no=no: batch(c) == no))
        if no == 2:
            forest = forest.merge()
    forest.drop()
    assert got == want and len(want) > 100


def _frame(spark, rows):
    return spark.createDataFrame(rows, "batch int, i bigint, text string").select(history.order_of(0, F.col("batch"), F.col("i")).alias("ord"), F.lit(False).alias("post"), "text")


def _pairs(x):
    return {(r.k, r.d) for r in x.select(history.row_of(F.col("kept")).alias("k"), history.row_of(F.col("dup")).alias("d")).collect()}


def test_history_is_found_again_by_another_session(spark, tmp_path):
    rows, _ = _history_rows()
    want, path = _brute(rows), f"file://{tmp_path}/forest"
    of = lambda no: [r for r in rows if r[0] == no]
    forest = history.build(spark, _frame(spark, of(0)), path=path)
    got = _pairs(history.admit(forest, _frame(spark, of(1))))
    forest.close()
    other = spark.newSession()
    again = history.Forest.open(other, path)
    got |= _pairs(history.admit(again, _frame(other, of(2))))
    again.merge()
    again.close()
    last = history.Forest.open(spark, path)
    assert len(last.runs) < 3 and sum(last.runs.values()) == last.entries().count() and last.rejected() is None
    got |= _pairs(history.admit(last, _frame(spark, of(3))))
    assert got == want
    last.drop()
    with pytest.raises(Exception, match="(?i)forest|exist"):
        history.Forest.open(spark, path)


def test_small_delivery_reads_only_its_buckets(spark):
    rows, _ = _history_rows()
    forest = history.build(spark, _frame(spark, [r for r in rows if r[0] == 0]), buckets=64)
    text = "a text of which the history holds nothing, that is long enough to be compared with it"
    asked = history.lookups(history._entries(history.sign(_frame(spark, [(1, 5000, text)]))), 5)
    routes = [r[0] for r in asked.select("route").distinct().collect()]
    plan = history.candidates(asked, forest.entries().filter(F.col("route").isin(routes)), 5)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: " in plan and int(plan.split("SelectedBucketsCount: ")[1].split()[0]) <= history.TREES
    # The forest's side of a look-up isn't shuffled.
    assert plan.count("Exchange hashpartitioning(route") == 1
    forest.drop()


@pytest.mark.parametrize("in_history", [True, False])
def test_hot_group_of_near_copies_costs_its_size(spark, monkeypatch, in_history):
    # Near-copies, all different: a third of the rows and more; and some that repeat later ones of them only.
    r = random.Random(3)
    base = [f"word{r.randrange(10**6)}" for _ in range(60)]
    rows = []
    for k in range(400):
        w = list(base)
        w[r.randrange(60)] = f"other{k}"
        if k % 40 == 39:
            for j in range(0, 9):
                w[j * 6] = f"far{k}"
        rows.append((0 if in_history and k < 200 else 1, k, " ".join(w)))
    for k in range(300):
        rows.append((1, 1000 + k, " ".join(f"x{r.randrange(10**6)}" for _ in range(20))))
    rows.sort()
    forest = history.build(spark, _frame(spark, [x for x in rows if x[0] == 0]))
    step_pairs = []
    real = history._Steps.__call__
    monkeypatch.setattr(history._Steps, "__call__", lambda self, df: (lambda t: (step_pairs.append(t.count()) if t.columns == ["dup", "kept"] else None, t)[1])(real(self, df)))
    got = _pairs(history.admit(forest, _frame(spark, [x for x in rows if x[0] == 1]), commit=False))
    forest.drop()
    assert got == _brute(rows)
    # All pairs of the group would be some 60,000 (of the history's half with the other 40,000).
    assert sum(step_pairs) < 30_000


def test_history_empty(spark):
    empty = spark.createDataFrame([], "ord bigint, post boolean, text string")
    forest = history.build(spark, empty)
    assert history.admit(forest, empty, lambda c: F.lit(True)).count() == 0
    forest.drop()


# --- queries ----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark, sf):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_oracle(name, spark, sf):
    from oracle import compare, connect

    compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])
