"""Cleaning rules: golden values, and the Column form against the Python form."""

import random

import pytest
from pyspark.sql import functions as F

from warraq.functions import clean, translit
from warraq.functions import text as T

GOLDEN = [
    ("السَّلَام عَلَيْكُم وَرَحْمَة الله", "السلام عليكم ورحمة الله"),
    ("ربي يرحمو ﷺ وربي يبارك ﷲ فيك", "ربي يرحمو صلى الله عليه وسلم وربي يبارك الله فيك"),
    ("عندي ١٥٠٠ دج", "عندي ١٥٠٠ دج"),
    ("😂😂😂", None),
    ("12:345 ok", "12:345 ok"),
    ("vu à 1:02:33 et ٣:٤٥ ok", "vu à et ok"),
    ("bien 😂🤷‍♀️", "bien 😂🤷‍♀️"),
    ("bien 😂😂😂😂", "bien 😂😂"),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("raw,want", GOLDEN)
def test_comment(raw, want):
    assert clean.clean_comment_text(raw) == want


def test_comment_placeholders():
    out = clean.clean_comment_text("شكرااااا بزاف خويا @someuser https://example.com/x")
    assert "[URL]" in out and "[MENTION]" in out and "https://" not in out and "شكرااااا" not in out


def test_post():
    assert clean.clean_post_text("أكبر تواجد بالمنتدى كان: 25,091 بتاريخ 2019-04-29") is None
    assert clean.clean_post_text("ﻻ تحدثني عن هذا ـــــ ابدا").startswith("لا تحدثني عن هذا")
    assert clean.clean_post_text("اقتباس:\nالمشاركة الأصلية كتبت بواسطة nour\nهذا ردي الحقيقي هنا") == "هذا ردي الحقيقي هنا"
    assert clean.clean_post_text("[b]x y[/b] [URL] z") == "x y [URL] z"


def _noise(n=1500):
    r = random.Random(3)
    alphabet = list("aab c.!?،,\n\t ") + ["@u ", "http://x.y ", "12:30", "😂", "🤷", "‍", "️", "♀", "ـ", "َ", "س", "سس", "ﻻ", "​", "[b]", "[/b]", "[URL]", "é", "²", "𝒜", " ", "www.a "]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_column_and_python_agree(spark):
    texts = [*_noise(), *[g for g, _ in GOLDEN]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", clean.clean_comment(F.col("text")).alias("c"), clean.clean_post(F.col("text")).alias("p")).collect()
    a, b = clean.clean_comment_texts(texts), clean.clean_post_texts(texts)
    for r in rows:
        assert r["c"] == a[r["i"]] == clean.clean_comment_text(texts[r["i"]])
        assert r["p"] == b[r["i"]] == clean.clean_post_text(texts[r["i"]])


def test_shingles_and_classes(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcde",), (None,)], "t string")
    assert [r[0] for r in df.select(T.char_shingles(F.col("t"))).collect()] == [[], ["ab"], ["abcd", "bcde"], None]
    x = spark.createDataFrame([("https://www.youtube.com/channel/UCabc/",), ("@h",), ("h",), ("https://x.y/@handle/",)], "u string").select(T.channel_ref(F.col("u")).alias("r")).collect()
    assert [(r.r.channel_id, r.r.handle) for r in x] == [("UCabc", None), (None, "h"), (None, "h"), (None, "handle")]


def test_transliteration():
    assert translit.text("في") == "fi"
    assert translit.text("يبارك abc") == "ybark abc".replace("ybark", translit.word("يبارك", translit.likeliest))
    pick = translit.drawn(3)
    assert translit.text("الله يبارك فيك", pick, "7") == translit.text("الله يبارك فيك", pick, "7")
    from warraq.functions import translit_tables as t

    for options in [*t.LETTERS.values(), *t.WORDS.values(), t.ARTICLE, *[o for w in t.WEAK.values() for o in w.values()]]:
        assert abs(sum(w for _, w in options) - 1) < 1e-4
