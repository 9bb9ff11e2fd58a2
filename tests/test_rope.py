import random
import time

import pytest

from tessera.functions import rope
from tessera.functions.rope import Rope


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_same_as_a_string(monkeypatch, chunk):
    monkeypatch.setattr(rope, "CHUNK", chunk)
    for seed in range(20):
        rng = random.Random(seed)
        plain = "".join(rng.choice("ab😀é") for _ in range(rng.randint(0, 30)))
        text = Rope(plain)
        for _ in range(120):
            at, new = rng.randint(0, len(plain)), "".join(rng.choice("xyz😀") for _ in range(rng.choice([0, 1, 2, 9])))
            text.insert(at, new)
            plain = plain[:at] + new + plain[at:]
            assert len(text) == len(plain)
        assert str(text) == plain


def test_positions_outside():
    text = Rope("abc")
    for at in (-1, 4):
        with pytest.raises(IndexError):
            text.insert(at, "x")
    assert str(text) == "abc"


def test_time_does_not_grow_with_the_text():
    def seconds(size):
        text, rng = Rope("x" * size), random.Random(1)
        began = time.process_time()
        for _ in range(5000):
            text.insert(rng.randint(0, len(text)), "abcde")
        return time.process_time() - began

    assert seconds(8_000_000) < 12 * seconds(80_000) + 0.5
