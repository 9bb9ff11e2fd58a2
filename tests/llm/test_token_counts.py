import random

import public_tokenizers
import pyarrow as pa
import pytest
from helpers import corpus, documents

from tessera.llm import token_counts

PATHS = {name: public_tokenizers.path(name) for name in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json")}


def expected(path, texts):
    """The library's own counts of whole texts."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(1)
    parts = ["the", "Haus ", " ", "  ", "\t", "\n\n", "é", "é", "ﬁ", "ｆ", "▁", "▁a", "</s>", "<s>", "[INST]", "<|endoftext|>", "<0x0A>", "漢字", "😀", "​", "\x00", "xx", "'s", "123", "...", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(120)] + ["", " ", "\n", "x" * 5000, "漢" * 3000, "▁" * 700, "  " * 900, "a " * 900 + " "]


@pytest.mark.parametrize("name", PATHS)
@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 14])
def test_cut_texts_have_the_librarys_counts(monkeypatch, name, piece):
    monkeypatch.setattr(token_counts, "PIECE", piece)
    monkeypatch.setattr(token_counts, "BATCH", 500)
    texts = odd_texts()
    got = token_counts.token_counts(token_counts.opened(PATHS[name]), pa.array(texts))
    assert got.tolist() == expected(PATHS[name], texts)


def test_long_text_is_cut(monkeypatch):
    model = token_counts.opened(PATHS["piece_bpe_32k.model"])
    text = "the quick brown fox jumps over " * 40_000
    pieces = list(model.pieces(text))
    assert len(pieces) > 50 and max(len(p) for p, _ in pieces) < 2 * token_counts.PIECE
    assert token_counts.token_counts(model, pa.array([text, None])).tolist() == [*expected(PATHS["piece_bpe_32k.model"], [text]), 0]


@pytest.mark.parametrize("name", PATHS)
def test_counted(spark, name):
    rows = corpus(2)
    got = token_counts.counted(documents(spark, rows), path=PATHS[name], limit=60)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [x or "" for _, x in rows]
    want = [(i, len(x.encode()), n, n > 60) for (i, _), x, n in zip(rows, texts, expected(PATHS[name], texts), strict=True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.counted(documents(spark, []), path=PATHS[name]).count() == 0


def test_guard_is_taken_off():
    model = token_counts.opened(PATHS["piece_bpe_32k.model"])
    assert model.cuts and model.guard == 2
    both = model.model.encode("x\n ab")
    assert both[-len(model.model.encode("ab")) :] == model.model.encode("ab")
    assert model.counts(["\n ab"])[0] - model.guard == len(model.model.encode("ab"))
