"""Misspellings of every term of the lexicon are found, wherever the error lies."""

import random

from geopressure.llm import toxicity


def test_every_long_term_is_found_with_one_error():
    letters = "bcdfghjklm"
    plain = [letters[k // 10] * 2 + "a" + letters[k % 10] * 2 + "oz" for k in range(100)]
    terms = {t + "$" * (k % 2): 100.0 - k / 10 for k, t in enumerate(plain)} | {"vuxyq": 1.0}
    lexicon = toxicity.Lexicon(terms)
    for term in terms:
        word = term.rstrip("$")
        for bad in ("w" + word[1:], word[:1] + word[2:], word[:3] + "w" + word[3:], word[:-1] + "w"):
            assert bad in lexicon.search([bad]), (term, bad)
    assert lexicon.search(["vuxwq"])["vuxwq"][0] == "vuxyq"


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_search_equals_brute_force_over_the_lexicon():
    rng = random.Random(2)
    make = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randint(low, high)))
    for _ in range(40):
        terms = {make(3, 7) + rng.choice(("", "$")): rng.random() for _ in range(6)}
        words = sorted({make(3, 12) for _ in range(120)})
        got = toxicity.Lexicon(terms).search(words)
        for word in words:
            want = {0: [], 1: []}
            for term, weight in terms.items():
                plain = term.rstrip("$")
                heads = [word] if term.endswith("$") else [word[:k] for k in range(len(word) + 1)]
                least = min(edits(plain, head) for head in heads)
                if least == 0:
                    want[0].append(weight)
                if least <= 1 and len(plain) >= toxicity.FUZZY:
                    want[1].append(weight)
            best = (max(want[0]), 0) if want[0] else (max(want[1]), 1) if want[1] else None
            assert (got[word][1:] if word in got else None) == best, (word, terms)
