"""How many tokens each text has, without keeping the tokens.

Texts go to the tokenizer in batches of about the same number of bytes, and
only lengths leave the Arrow function.  A long text is cut where no token can
reach across, so its length is the sum over its pieces and no task holds the
tokens of a whole long text.

A sentencepiece model joins two symbols only where their text stands in its
vocabulary.  A place between two characters that are neighbours in no piece of
the vocabulary is therefore safe.  The model writes a blank before a text; a
later piece has a line feed before it instead, which is a neighbour of nothing
in such a vocabulary, and what the line feed alone gives is taken off again.
A tokenizers file is cut between an ASCII letter and a blank that another ASCII
letter follows, where its patterns cut themselves.  A text without a safe place
stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_bytes, tidy

#: Characters after which a text is cut at the next safe place.
PIECE = 1 << 14
#: Bytes of text that are encoded at once.
BATCH = 1 << 18

_BLANK, _GUARD = "▁", "\n"
_BETWEEN = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


class PieceModel:
    """Counts of a sentencepiece model, without begin and end."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size()) if not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k))]
        self.neighbours = {pair for piece in pieces for pair in zip(piece, piece[1:], strict=False)}
        self.guard = len(self.model.encode(_GUARD))
        # a model that rewrites texts, joins unknown characters or knows the line feed has no safe places
        probe = "a  b éé ﬁ ｆ e\u0301\t\n"
        same = self.model.decode(self.model.encode(probe)) == probe
        self.cuts = same and any(map(self.model.is_byte, range(self.model.get_piece_size()))) and not any(_GUARD in pair for pair in self.neighbours)

    def safe(self, text: str, at: int) -> int | None:
        """The first safe place from at on."""
        last = _BLANK if text[at - 1] == " " else text[at - 1]
        for k in range(at, len(text)):
            now = _BLANK if text[k] == " " else text[k]
            if (last, now) not in self.neighbours:
                return k
            last = now
        return None

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """(piece, whether it has the line feed before it)."""
        at = 0
        while self.cuts and len(text) - at > PIECE and (end := self.safe(text, at + PIECE)) is not None:
            yield (_GUARD + text[at:end] if at else text[at:end]), at > 0
            at = end
        yield (_GUARD + text[at:] if at else text), at > 0

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(pieces, num_threads=1)]


class TokenizersModel:
    """Counts of a tokenizers file, without added special tokens, cut or filled up."""

    guard = 0

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        while len(text) - at > PIECE and (found := _BETWEEN.search(text, at + PIECE)):
            yield text[at : found.start()], False
            at = found.start()
        yield text[at:], False

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode_batch_fast(pieces, add_special_tokens=False)]


def opened(path: str) -> PieceModel | TokenizersModel:
    """The tokenizer in a file, .model or .json."""
    return PieceModel(path) if path.endswith(".model") else TokenizersModel(path)


_MODELS: dict[str, PieceModel | TokenizersModel] = {}


def token_counts(model: PieceModel | TokenizersModel, texts: pa.Array) -> np.ndarray:
    """The number of tokens of each text of a string column; null is empty."""
    out = np.zeros(len(texts), dtype=np.int64)
    pieces: list[str] = []
    rows: list[int] = []
    guards: list[int] = []
    size = 0

    def flush():
        if pieces:
            np.add.at(out, rows, np.array(model.counts(pieces)) - model.guard * np.array(guards))
            pieces.clear(), rows.clear(), guards.clear()

    for k, text in enumerate(texts):
        for piece, guarded in model.pieces(text.as_py() or ""):
            if piece:
                pieces.append(piece), rows.append(k), guards.append(guarded)
                size += len(piece)
                if size >= BATCH:
                    flush()
                    size = 0
    flush()
    return out


def counted(documents: DataFrame, *, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of documents (doc_id, text).

    path names a .model or .json file that every worker can read.  Null and empty
    texts have 0 bytes and tokens.  Strings that look like special tokens count as
    the library's encode takes them by default.  Repeated rows and null ids
    stay, a row each; empty tables give no rows; other columns are not looked at.
    """

    @tidy
    def count(batches):
        model = _MODELS.get(path) or _MODELS.setdefault(path, opened(path))
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(token_counts(model, batch.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
