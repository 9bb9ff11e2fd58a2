import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, rans

tokenizers = pytest.importorskip("tokenizers")


def plain(texts):
    coder = tokenizers.Tokenizer.from_file(rans.public_tokenizer())
    return [coder.encode(t or "", add_special_tokens=False).ids for t in texts]


ODD = ["  a b\n\n c  d \n\ne <|endoftext|> x  ", " ", "\n\n", "", "é è\u0085 x", "<|endoftext|>", "x\t\ty z's don't 12 3,4", "日本 語　 a", "a \n\nb", "  \n q", "a" * 300, "👍🏽 \U0001f468‍👩 x", "\r\n\r\n a", "\x00 \x1c a"]


def test_pieces_are_the_tokenizer(spark):
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice(["a", "B", " ", "\n", "\t", ".", "'s", "é", " ", " ", "1", "<|endoftext|>"]) for _ in range(40)) for _ in range(400)]
    coder = rans.PieceEncoder(rans.public_tokenizer())
    for _ in range(2):  # learning, then remembering
        found = []
        for _, data, offsets in common.chunks(pa.array(texts)):
            ids, many = coder.encode(data, offsets)
            cut = np.cumsum(many) - many
            found += [ids[a : a + m].tolist() for a, m in zip(cut, many, strict=True)]
        assert found == plain(texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(0, 3))
def test_round_trip(ids, power):
    ids = np.array(ids, dtype=np.uint32) ** power % 50257
    table = rans.Table(rans.normalised(np.bincount(ids, minlength=50257) + (power == 1)))
    sizes = [len(ids) // 2, len(ids) - len(ids) // 2]
    block = rans.Block(rans.encode(ids, np.array(sizes), table))
    assert block.all(table).tolist() == ids.tolist()
    assert block.sizes.tolist() == sizes


def test_parts_decode_alone_and_are_checked():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.01, 3 * rans.LANES * rans.CHECKPOINT - 77), 5000).astype(np.uint32)
    table = rans.Table(rans.normalised(np.bincount(ids)))
    payload = rans.encode(ids, np.array([len(ids)]), table)
    block = rans.Block(payload)
    assert block.parts == 3
    size = rans.LANES * rans.CHECKPOINT
    for k in (2, 0, 1):
        assert block.part(k, table).tolist() == ids[k * size : (k + 1) * size].tolist()
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(payload) < entropy * 1.03 + 8 * rans.LANES * 3 + 200
    broken = bytearray(payload)
    broken[-len(ids) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.Block(bytes(broken)).all(table)
    with pytest.raises(ValueError):
        rans.encode(np.array([4999999]), np.array([1]), rans.Table(np.append(np.zeros(5000000, int), 1 << 20)))


def test_normalised():
    f = rans.normalised(np.array([0, 1, 10**12, 5]))
    assert f.sum() == 1 << 20
    assert f[0] == 0
    assert f[1] >= 1
    many = rans.normalised(np.ones(50_000))
    assert many.sum() == 1 << 20
    assert many.min() >= 1
    assert rans.normalised(np.zeros(3)).sum() == 0


def test_files(spark, tmp_path):
    rows = corpus(4)
    rows += [(500, prose(random.Random(1), 20000))]
    path = str(tmp_path / "tokens")
    rans.write_tokens(documents(spark, rows), path, tokenizer=rans.public_tokenizer())
    found = rans.read_tokens(spark, path).orderBy("start").collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == sorted((i for i, _ in rows), key=repr)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert ids == sorted(ids)
    by_id = {}
    for (i, _), x in zip(rows, plain(t for _, t in rows), strict=True):
        by_id.setdefault(i, set()).add((len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())))
    start = 0
    for r in found:
        assert r["start"] == start
        assert (r["n_tokens"], r["ids_crc32"]) in by_id[r["doc_id"]]
        start += r["n_tokens"]


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    rans.write_tokens(documents(spark, []), path, tokenizer=rans.public_tokenizer())
    assert rans.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("fault", ["hash", "bytes"])
def test_pieces_of_one_hash_and_ids_over_two_pieces(fault, monkeypatch):
    """What the remembered pieces cannot tell is encoded alone."""
    rng = random.Random(3)
    texts = ODD + [prose(rng, 30) for _ in range(20)]
    coder = rans.PieceEncoder(rans.public_tokenizer())
    if fault == "hash":
        own = rans.hash_spans
        monkeypatch.setattr(rans, "hash_spans", lambda *a: own(*a) % np.uint64(7))
    else:
        coder.bytes = coder.bytes * 0 + 3
    found = []
    for _, data, offsets in common.chunks(pa.array(texts)):
        ids, many = coder.encode(data, offsets)
        cut = np.cumsum(many) - many
        found += [ids[a : a + m].tolist() for a, m in zip(cut, many, strict=True)]
    assert found == plain(texts)


def test_rows_of_one_id_have_one_order(spark, tmp_path):
    rows = [(4, "b c"), (4, None), (4, "a"), (None, "z"), (4, "a"), (2, "word " * 300_000)]
    runs = []
    for k, given in enumerate((rows, rows[::-1])):
        rans.write_tokens(documents(spark, given), str(tmp_path / str(k)), tokenizer=rans.public_tokenizer(), shards=3)
        runs.append(sorted(map(tuple, rans.read_tokens(spark, str(tmp_path / str(k))).collect()), key=lambda r: r[1]))
    assert runs[0] == runs[1]
    ids = [[*x, 0] for x in plain(["z", "word " * 300_000, None, "a", "a", "b c"])]
    assert [r[3] for r in runs[0]] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert [r[1] for r in runs[0]] == np.cumsum([0, *map(len, ids)])[:-1].tolist()


def test_counts_of_ids_are_read_without_the_ids(spark):
    """A shard's counts stand in a column of their own, so that the column of ids isn't scanned for them."""
    tokenizer = rans.public_tokenizer()
    df = spark.createDataFrame([(1, "one two two"), (2, None), (3, "two")], "doc_id long, text string").coalesce(1)
    rows = df.mapInArrow(lambda it: rans._tokenise(it, tokenizer, 0), "shard int, at long, before long, doc_id long, ids binary, counts binary").collect()
    ids = [k for r in rows if r["at"] >= 0 for k in np.frombuffer(r["ids"], "<u4").tolist()]
    assert all((r["ids"] is None) == (r["at"] < 0) and (r["counts"] is None) == (r["at"] >= 0) for r in rows)
    told = next(r for r in rows if r["at"] < 0)
    many = len(told["counts"]) // 12
    counts = dict(zip(np.frombuffer(told["counts"], "<u4", many).tolist(), np.frombuffer(told["counts"], "<u8", many, 4 * many).tolist(), strict=True))
    assert told["before"] == len(ids) and counts == {k: ids.count(k) for k in ids}
