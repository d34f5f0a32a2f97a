"""op5: fingerprints of words by prefix sums."""

import random
import time

import numpy as np
import pyarrow as pa

from quarry.llm.passages import fingerprints, window_keys
from quarry.llm.textkit import Words

RNG = random.Random(3)
TEXTS = [" ".join(RNG.choice("ab cd ef gh ij".split()) for _ in range(n)) for n in (0, 3, 6, 7, 8, 9, 40, 200)] + [None, "x " * 60]


def test_each_window_has_its_least_gram_and_no_other_is_chosen():
    for noise, guarantee in ((3, 7), (4, 5), (5, 5), (1, 9)):
        w = Words(pa.array(TEXTS * 2))
        g, doc, at = fingerprints(w, noise, guarantee)
        got = {(d, a): x for x, d, a in zip(g.tolist(), doc.tolist(), at.tolist())}
        one, key, need = {}, {}, set()  # equal grams have one hash, unequal ones do not
        for d, t in enumerate(TEXTS * 2):
            words = (t or "").split()
            for s in range(len(words) - guarantee + 1):
                inside = [(d, a) for a in range(s, s + guarantee - noise + 1)]
                chosen = [p for p in inside if p in got]
                assert chosen
                least = min(got[p] for p in chosen)
                need.add(min(p for p in chosen if got[p] == least))
            for (_, a), x in ((p, x) for p, x in got.items() if p[0] == d):
                gram = tuple(words[a : a + noise])
                assert len(gram) == noise and one.setdefault(gram, x) == x and key.setdefault(x, gram) == gram
        assert need == set(got)
        k, of, place = window_keys(w, doc, at, noise, guarantee)
        assert set(zip(of.tolist(), place.tolist())) == {(d, s) for d, t in enumerate(TEXTS * 2) for s in range(len((t or "").split()) - guarantee + 1)}
        content = {}
        for x, d, s in zip(k.tolist(), of.tolist(), place.tolist()):
            assert content.setdefault(x, run := (TEXTS * 2)[d].split()[s : s + guarantee]) == run


def test_a_long_gram_costs_no_more_than_a_short_one():
    w = Words(pa.array([" ".join(map(str, np.random.default_rng(1).integers(0, 10_000, 200_000)))]))

    def seconds(noise):
        took = []
        for _ in range(3):
            began = time.process_time()
            fingerprints(w, noise, noise + 20)
            took.append(time.process_time() - began)
        return min(took)

    seconds(30)
    assert seconds(480) < 4 * seconds(30)
