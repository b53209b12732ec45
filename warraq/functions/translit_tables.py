"""Weighted renderings of Arabic letters and frequent words (fixed values)."""

# Rendering weights by letter.
LETTERS: dict[str, tuple[tuple[str, float], ...]] = {
    "أ": (("a", 0.90), ("e", 0.10)),
    "إ": (("i", 0.80), ("e", 0.20)),
    "آ": (("a", 0.90), ("aa", 0.10)),
    "ا": (("a", 0.85), ("e", 0.15)),
    "ب": (("b", 1.00),),
    "ت": (("t", 1.00),),
    "ث": (("th", 0.60), ("t", 0.40)),
    "ج": (("j", 0.70), ("dj", 0.30)),
    "ح": (("7", 0.80), ("h", 0.20)),
    "خ": (("kh", 0.70), ("5", 0.30)),
    "د": (("d", 1.00),),
    "ذ": (("dh", 0.50), ("d", 0.50)),
    "ر": (("r", 1.00),),
    "ز": (("z", 1.00),),
    "س": (("s", 1.00),),
    "ش": (("ch", 0.80), ("sh", 0.20)),
    "ص": (("s", 0.90), ("9", 0.10)),
    "ض": (("d", 0.80), ("dh", 0.20)),
    "ط": (("t", 0.70), ("6", 0.30)),
    "ظ": (("dh", 0.60), ("d", 0.40)),
    "ع": (("3", 0.80), ("a", 0.20)),
    "غ": (("gh", 0.80), ("r", 0.20)),
    "ف": (("f", 1.00),),
    "ق": (("9", 0.50), ("g", 0.30), ("q", 0.20)),
    "ڨ": (("g", 1.00),),
    "ك": (("k", 1.00),),
    "ل": (("l", 1.00),),
    "م": (("m", 1.00),),
    "ن": (("n", 1.00),),
    "ه": (("h", 1.00),),
    "و": (("ou", 0.60), ("o", 0.20), ("w", 0.20)),
    "ي": (("i", 0.60), ("y", 0.30), ("e", 0.10)),
    "ة": (("a", 0.70), ("e", 0.20), ("t", 0.10)),
    "ى": (("a", 0.80), ("i", 0.20)),
    "ء": (("'", 0.50), ("", 0.50)),
    "ئ": (("i", 0.80), ("y", 0.20)),
    "ؤ": (("ou", 0.80), ("o", 0.20)),
    "لا": (("la", 1.00),),
}

# Renderings of frequent words.
WORDS: dict[str, tuple[tuple[str, float], ...]] = {
    "و": (("w", 0.80), ("ou", 0.20)),
    "في": (("fi", 1.00),),
    "الله": (("allah", 0.5), ("ellah", 0.5)),
    "من": (("men", 0.80), ("man", 0.20)),
    "ربي": (("rabi", 0.80), ("rabbi", 0.15), ("rebby", 0.05)),
    "على": (("3la", 0.80), ("ala", 0.20)),
    "انا": (("ana", 1.00),),
    "أنا": (("ana", 1.00),),
    "لي": (("li", 1.00),),
    "ما": (("ma", 1.00),),
    "يا": (("ya", 1.00),),
    "لا": (("la", 1.00),),
    "كي": (("ki", 1.00),),
    "تاع": (("ta3", 0.70), ("ta3e", 0.30)),
    "تع": (("te3", 0.70), ("ta3", 0.30)),
    "والله": (("wallah", 1.00),),
    "هذا": (("hada", 1.00),),
    "غير": (("ghir", 1.00),),
    "ولا": (("wla", 1.00),),
    "راني": (("rani", 1.00),),
    "بصح": (("bsh", 0.50), ("besah", 0.50)),
    "كل": (("kol", 0.70), ("koul", 0.30)),
    "بزاف": (("bzaf", 0.50), ("bezzaf", 0.50)),
    "واحد": (("wahed", 1.00),),
    "وين": (("win", 1.00),),
    "كان": (("kan", 1.00),),
    "راك": (("rak", 1.00),),
    "كاين": (("kayen", 1.00),),
    "خويا": (("khouya", 1.00),),
    "مع": (("m3a", 1.00),),
    "واش": (("wach", 1.00),),
    "عندي": (("3andi", 1.00),),
    "علاه": (("3lah", 1.00),),
    "عليك": (("3lik", 1.00),),
    "كنت": (("kont", 0.80), ("kount", 0.20)),
    "حتى": (("hata", 1.00),),
    "فيك": (("fik", 1.00),),
    "هي": (("hiya", 1.00),),
    "انت": (("nta", 1.00),),
    "باش": (("bach", 1.00),),
    "او": (("ou", 1.00),),
    "خير": (("khir", 1.00),),
    "شكرا": (("chokran", 1.00),),
    "حاجة": (("haja", 1.00),),
    "دير": (("dir", 1.00),),
    "صح": (("sah", 1.00),),
    "ماشي": (("machi", 1.00),),
    "كيما": (("kima", 1.00),),
    "شكون": (("chkoun", 1.00),),
    "راهي": (("rahi", 1.00),),
    "حنا": (("hna", 1.00),),
    "راه": (("rah", 1.00),),
    "رانا": (("rana", 1.00),),
    "يكون": (("ykoun", 1.00),),
}

# The article, and the weak letters by position.
ARTICLE = (("el", 0.60), ("l", 0.30), ("al", 0.10))
WEAK: dict[str, dict[str, tuple[tuple[str, float], ...]]] = {
    "ي": {
        "first": (("y", 0.95), ("i", 0.05)),
        "last": (("i", 0.90), ("y", 0.10)),
        "between": (("i", 0.75), ("e", 0.20), ("ie", 0.05)),
        "other": (("y", 0.85), ("i", 0.15)),
    },
    "و": {
        "first": (("w", 0.95), ("ou", 0.05)),
        "last": (("ou", 0.65), ("o", 0.25), ("u", 0.10)),
        "between": (("ou", 0.75), ("o", 0.20), ("u", 0.05)),
        "other": (("w", 0.80), ("ou", 0.20)),
    },
    "ا": {
        "first": (("a", 0.85), ("e", 0.15)),
        "last": (("a", 0.95), ("e", 0.05)),
        "between": (("a", 0.90), ("aa", 0.10)),
        "other": (("a", 0.90), ("aa", 0.10)),
    },
}
VOWELS = frozenset("اي وأإآىئؤء".replace(" ", ""))
