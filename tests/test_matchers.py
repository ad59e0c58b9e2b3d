"""Matchers take the words of a batch at once, with what plain loops over each word give."""

import random
import re

import pyarrow as pa

from stackwise.operators import lexical

ODD = ["", "a", "ab", "x_1", "İstanbul", "ΣΑΣ", "知识库abc", "ab知", "ÉTÉ", "straße", "🙂ab", "abİcd", "naïve", "aaaa", "a" * 300]
CJK = "぀-ヿ㐀-䶿一-鿿가-힯"


def words():
    rng = random.Random(1)
    return ODD + ["".join(rng.choices("abéß知_7", k=rng.randint(1, 9))) for _ in range(2000)]


def rows(match, given):
    out = [{} for _ in given]
    for i, number, times in zip(*(x.tolist() for x in match.each(pa.array(given)))):
        assert number not in out[i]
        out[i][number] = times
    return out


def places(word, t):
    return sum(word.startswith(t, at) for at in range(len(word)))


def test_terms_and_parts_of_many_words(monkeypatch):
    given = words()
    terms = ["aba", "abab", "été", "σας", "i̇st", "知识库", "ss知", "aaa", "_7_"]
    parts = ["a", "知", "ab", "🙂", "ß", "é7"]
    for most in (1 << 21, 1):  # by tables, and by looking keys up
        monkeypatch.setattr(lexical, "MOST_LISTED", most)
        assert rows(lexical.Folded(terms), given) == [{i: n for i, t in enumerate(terms) if (n := places(w.lower(), t))} for w in given]
        assert rows(lexical.Parts(parts), given) == [{i: 1 for i, t in enumerate(parts) if t in w} for w in given]
    assert rows(lexical.Folded([]), given) == [{}] * len(given) == rows(lexical.Tokens([]), given)


def test_tokens_of_many_words():
    given = words()
    known = ["ab", "ba", "x_1", "abc", "知识", "识库", "知", "知知", "aaaa", "7_", "cd"]
    want = []
    for w in given:
        runs = re.findall(f"[{CJK}]+", w.lower())
        all_tokens = re.findall("[a-z0-9_]{2,}", w.lower()) + [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
        want.append({i: n for i, t in enumerate(known) if (n := all_tokens.count(t))})
    assert rows(lexical.Tokens(known), given) == want and any(len(x) > 1 for x in want)
