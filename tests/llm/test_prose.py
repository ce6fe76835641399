"""The array statistics of segments against regular expressions, piece by piece."""

import random

import regex

from ledgerline.llm import prose as P
from ledgerline.llm.quality import COMMON_WORDS

COMMON = set(COMMON_WORDS)


def plain(piece):
    t = piece.lower()
    words = regex.findall(r"\p{L}+(?:['’]\p{L}+)?", t)
    size = len(regex.sub(r"[ \t\n\x0b\f\r]", "", t))
    n = len(words)
    rules = [
        n < P.LEAST_WORDS,
        len(regex.findall(r"[{}\[\]()=<>_/\\|@#$%^&*+~`\"]", t)) > P.MOST_SYMBOLS * size,
        len(regex.findall(r"\p{L}", t)) < P.LEAST_LETTERS * size,
        n > P.MOST_GLUED * len(t.split()),
        sum(w in COMMON for w in words) < P.LEAST_COMMON * n,
        len(set(words)) < min(10, max(3, P.LEAST_DISTINCT * n)),
    ]
    return size, n, rules.index(True) + 1 if any(rules) else 0


def test_pieces_against_regular_expressions():
    rnd = random.Random(4)
    bits = ["the", "of", "und", "que", "Straße", "don't", "rock'n'roll", "l’été", "x=1", "f(a)", "漢字", "a_b", "12", "…", "word", "Word", "(so)", "été", "ﬁne", "--", "über", "'tis", "it''s"]
    pieces = [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(400)] + ["", " ", "a"]
    size, words, failed = P._measure(pieces)
    assert list(zip(size.tolist(), words.tolist(), failed.tolist())) == [plain(p) for p in pieces]


def test_reasons_and_order_of_chunks():
    good = "The maintainer said that the report had been split before the deadline, so nobody read it."
    texts = [good, None, "", "word", "- one\n- two", "x = f(y[1])\n" * 5, good.lower().rstrip(".")] * 3 + [good * 9000]
    share, worst = P.measure_texts(texts)
    assert share[:7].tolist() == [1, 0, 0, 0, 0, 0, 1] and share[7:14].tolist() == share[:7].tolist()
    assert worst[:6].tolist() == [0, -1, -1, 1, P._LIST, P._SHORT] or worst[5] > 0
    one_by_one = [P.measure_texts([t])[0][0] for t in texts]
    assert share.tolist() == one_by_one
