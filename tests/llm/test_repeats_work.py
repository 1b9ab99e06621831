from __future__ import annotations

import random

import numpy as np

from shotmetrics.llm import repeats


class Counted(list):
    looked = 0

    def __getitem__(self, i):
        type(self).looked += 1
        return super().__getitem__(i)


def test_unknown_words_climb_no_links_and_matches_are_those_of_brute_force():
    rng = random.Random(4)
    known = [rng.choice([b"a", b"b", b"c"]) for _ in range(200)]
    automaton = repeats.SuffixAutomaton()
    automaton.add(3, known)
    automaton.finish()
    words = known[50:120] + [b"new"] + known[10:60]
    held = {tuple(known[i : i + 13]) for i in range(len(known) - 12)}
    assert automaton.matched(5, words, 13) == [i for i in range(len(words) - 12) if tuple(words[i : i + 13]) in held]
    assert automaton.matched(3, words, 13) == []
    automaton.link = Counted(automaton.link)
    automaton.matched(5, [w for k in known[:40] for w in (k, b"new")], 13)
    assert Counted.looked == 0  # every unknown word climbed to the root before


def test_representatives_are_the_least_of_each_window():
    words = [b"w%d" % (i * 7 % 11) for i in range(60)]
    for width in (3, 5, 6, 13, 20):
        find = repeats.Representatives(width)
        alone = [int(find(words[i : i + width])[0]) for i in range(len(words) - width + 1)]
        assert np.array_equal(find(words), alone)
