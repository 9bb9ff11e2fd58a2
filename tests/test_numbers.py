import random
import re

import pytest
from pyspark.sql import types as T

from tessera.schema import WEATHER
from tessera.sources import numbers
from tessera.sources.numbers import FRACTION, OUTSIDE, WHOLE


def plain(data: bytes) -> list[str]:
    """The numbers, byte by byte."""
    out, state = [], OUTSIDE
    for c in data.decode("latin-1"):
        if c == "-" or (c in "0123456789" and state == OUTSIDE) or (c == "." and state != WHOLE):
            out.append(c)
            state = FRACTION if c == "." else WHOLE
        elif c in "0123456789.":
            out[-1] += c
            state = FRACTION if c == "." else state
        else:
            state = OUTSIDE
    return out


def some_bytes(rng, n):
    return bytes(rng.choice(b"0123456789-.. \n\x00x\xffe+") for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_functions_compose_and_numbers_are_found_wherever_bytes_are_cut(seed):
    rng = random.Random(seed)
    data = some_bytes(rng, rng.randint(0, 80))
    assert plain(data) == re.findall(r"-\d*\.?\d*|\d+\.?\d*|\.\d*", data.decode("latin-1"))
    cuts = sorted(rng.randint(0, len(data)) for _ in range(rng.randint(0, 5)))
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
    got = [x for text in numbers.texts(iter(parts), OUTSIDE) for x in text.to_pylist()]
    assert got == plain(data)
    state, seen = OUTSIDE, 0
    for k, part in enumerate(parts):
        left, many = numbers.function(iter([part]))[state]
        later = [x for text in numbers.texts(iter(parts[k:]), state) for x in text.to_pylist()]
        assert later == plain(data)[seen:]  # a range that is entered inside a number leaves that number out
        state, seen = left, seen + many
    assert seen == len(plain(data)) and numbers.function(iter(parts))[OUTSIDE] == (state, seen)


def test_values():
    import pyarrow as pa

    text = pa.array(["-", ".", "-.", "5.", ".5", "-0.3", "12.9", "9" * 30, "1234567890123456789"], pa.large_string())
    assert numbers.numbers(text, T.DoubleType()).to_pylist() == [0, 0, 0, 5, 0.5, -0.3, 12.9, float("9" * 30), 1234567890123456789.0]
    assert numbers.numbers(text, T.LongType()).to_pylist() == [0, 0, 0, 5, 0, 0, 12, None, 1234567890123456789]


def records(data: bytes, skip=3):
    found = plain(data)[skip:]
    value = lambda c, x: (int(re.sub(r"\..*", "", x) or 0) if re.sub(r"\..*", "", x) not in ("", "-") else 0) if c < 2 else float(x) if re.search(r"\d", x) else 0.0
    return [tuple(value(c, found[k + c]) for c in range(7)) for k in range(0, len(found) - 6, 7)]


@pytest.mark.parametrize("range_bytes,block", [(7, 3), (64, 1 << 20), (1000, 10), (1 << 26, 1 << 20)])
def test_scan_by_ranges(spark, tmp_path, monkeypatch, range_bytes, block):
    """Small ranges in tasks; the block's length is taken by the workers of this process's settings, so it is tested below."""
    rng = random.Random(range_bytes)
    for k, n in enumerate((0, 5, 900, 2500)):
        (tmp_path / f"{k}.bin").write_bytes(some_bytes(rng, n))
    (tmp_path / "9.bin").write_bytes(b"3 1 2\n" + b"".join(b"%d,%d;1.5 x-2.25\n3 4 5%s" % (k, k % 3, b" junk." * (k % 2)) for k in range(40)))
    want = sorted(r for f in sorted(tmp_path.iterdir()) for r in records(f.read_bytes()))
    got = numbers.scan(spark, str(tmp_path), range_bytes=range_bytes)
    assert got.schema.names == WEATHER.names
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(numbers, "BLOCK", block)
    assert numbers.leading(str(tmp_path / "9.bin")) == [3, 1, 2]
    path = str(tmp_path / "3.bin")
    assert b"".join(numbers._blocks(path, 11, 700)) == (tmp_path / "3.bin").read_bytes()[11:700]
    assert b"".join(numbers._blocks(path, 2400)) == (tmp_path / "3.bin").read_bytes()[2400:]


def test_a_number_over_many_ranges_and_no_numbers(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1 1 1 " + b"4" * 15 + b" 2 " + b"0" * 200 + b".5 1 1 1 1")
    assert [tuple(r) for r in numbers.scan(spark, str(tmp_path), range_bytes=20).collect()] == [(444444444444444, 2, 0.5, 1, 1, 1, 1)]
    (tmp_path / "a").write_bytes(b"no numbers here")
    assert numbers.scan(spark, str(tmp_path)).count() == 0
    (tmp_path / "a").write_bytes(b"")
    assert numbers.scan(spark, str(tmp_path)).count() == 0


def test_tasks_are_dealt_by_bytes_not_by_ranges(spark, tmp_path):
    """Thousands of small ranges are read by few tasks, which read little past their ends."""
    data = b"1 1 1 " + b"".join(b"%d,%d;1.5 x-2.25\n3 4 5 " % (k, k % 3) for k in range(2000))
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").write_bytes(data[:30_001])
    found = numbers.scan(spark, str(tmp_path), range_bytes=16)
    assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, found.collect())) == sorted(records(data) + records(data[:30_001]))
    read = numbers._onwards(str(tmp_path / "a"), 100, 200)
    assert [next(read), next(read)] == [data[100:200], data[200 : 200 + numbers.BEYOND]]
    assert b"".join(read) == data[200 + numbers.BEYOND :]
    entry = lambda file, low, many: {"file": file, "low": low, "high": low + 9, "entered": low % 3, "first": low, "many": many}
    runs = list(numbers._runs([entry("a", 0, 1), entry("a", 9, 2), entry("a", 27, 3), entry("b", 36, 4)]))
    assert runs == [{"file": "a", "low": 0, "high": 18, "entered": 0, "first": 0, "many": 3}, entry("a", 27, 3), entry("b", 36, 4)]
