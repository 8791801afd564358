"""Facts of a text: the same as by their plain definitions, without a step of the interpreter per word."""

import itertools
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np

from cohortmill.llm import quality


def plain(text):
    words = text.lower().split()
    n = max(1, len(words))
    bare = [w.strip(b".,;:'\"?!()-*#$%&|") for w in words]
    counts = Counter(w for w in bare if w)
    same = [a == b for a, b in itertools.pairwise(words)]
    odd = [any(c not in quality.ORDINARY for c in w) for w in text.split()]
    insults = [w for w in counts if w.startswith(quality.INSULTS)]
    return {
        "n": len(words), "counts": counts, "odd": sum(odd) / n, "mean": sum(map(len, words)) / n,
        "doubled": len(re.findall(rb"([^\s\w\x80-\xff.])\1", text)) / n,
        "stutter": sum(same) / n, "triple": sum(a and b for a, b in itertools.pairwise(same)) / n,
        "function": sum(c for w, c in counts.items() if w in quality.FUNCTION_WORDS) / n,
        "insults": sum(counts[w] for w in insults), "insult_kinds": len(insults),
    }


def test_facts_by_their_definitions():
    draw = random.Random(8)
    texts = [bytes(draw.choice(b"ab#!.. \t\n\r\x0b\x0c\x00\x1c_-$\x80\xc3xX7") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    pieces = [b"Idiot", b"idiot.", b"(the", b"a", b"a", b"##idiots!!", b"imb\xc3\xa9cile", b"x", b"###", b"..", b"dum"]
    texts += [b" ".join(draw.choice(pieces) for _ in range(draw.randint(0, 40))) for _ in range(200)]
    for text in texts:
        facts = quality.Facts(text)
        assert {k: getattr(facts, k) for k in plain(text)} == plain(text), text
    assert quality.Facts(None).counts == {} and quality.doubled(b"#") == quality.doubled(b"") == 0


def test_slots_of_words_and_shapes():
    slots, values = quality.features(quality.Facts(b"One, two one 33 three"), "toxic")
    assert sorted(slots) == sorted(zlib.crc32(w) % quality.SLOTS for w in (b"one", b"two", b"33", b"three")) and set(values) == {1}
    slots, values = quality.features(quality.Facts(b"One, two one 33"), "poor")
    got = dict(zip(slots.tolist(), values.tolist(), strict=True))
    assert [got[zlib.crc32(b"shape:" + s) % quality.SLOTS] for s in (b"Aa,", b"a", b"0")] == [1, 2, 1]
    assert len(slots) == 12 and values.dtype == np.float32


def test_no_step_of_the_interpreter_per_word():
    text = " ".join(f"Word{k}, and## {k % 7}" for k in range(5000)).encode()
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        facts = quality.Facts(text)
        for task in quality.TASKS:
            quality.votes_of(facts, task)
    finally:
        sys.setprofile(None)
    # generators and functions of Python, not those of its library
    assert facts.n == 15000 and calls["call"] < 1000
