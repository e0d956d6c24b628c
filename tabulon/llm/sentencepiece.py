"""Encoding and decoding with the pieces of a SentencePiece model.

An Aho-Corasick automaton over the pieces reads a text once; at each position the matches that end
there come from the automaton's output links and relax the best score of a segmentation up to that
position (Viterbi). No piece crosses into a following word mark, so a text is cut in front of every
run of word marks and the best segmentation of the whole is that of its parts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tabulon.llm.common import Memory, packed, slices

#: Bytes of a column that are converted at once.
SLICE_BYTES = 4 << 20
MARK = "▁"
#: What a character without a piece costs below the worst piece.
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """The pieces, scores and byte pieces of a model file; the library only reads the file."""

    def __init__(self, path: str, dummy_prefix: bool = True):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        source = SentencePieceProcessor(model_file=path)
        self.dummy_prefix = dummy_prefix
        self.pieces = [source.id_to_piece(i) for i in range(source.vocab_size())]
        self.unknown = source.unk_id()
        self.silent = {i for i in range(len(self.pieces)) if source.is_control(i)}
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if source.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        usable = [
            i
            for i in range(len(self.pieces))
            if not (i in self.silent or i in self.byte_of or source.is_unknown(i) or source.is_unused(i))
        ]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            piece = self.pieces[i]
            self.automaton.add_word(piece, (len(piece), source.get_score(i), i))
        self.automaton.make_automaton()
        self.unknown_score = min(source.get_score(i) for i in usable) - UNKNOWN_PENALTY
        #: Characters with a piece of their own; for others the unknown character is a choice.
        self.single = {self.pieces[i] for i in usable if len(self.pieces[i]) == 1}
        self.parts = self._cuts([self.pieces[i] for i in usable])
        self.part = Memory(lambda part: packed(self.segment(part)))
        # What an id stands for: nothing, a byte, or the bytes of a piece.
        self.bytes = [
            b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else piece.encode()
            for i, piece in enumerate(self.pieces)
        ]

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern | None:
        """What finds the parts of a text that no piece crosses, as far as the pieces allow any."""
        pairs = {(a, b) for piece in pieces for a, b in zip(piece, piece[1:])}
        if any(b == MARK and a != MARK for a, b in pairs):
            return None
        line = "" if any("\n" in pair for pair in pairs) or "\n" in pieces else "\n"
        if any(a.isalnum() and not b.isalnum() for a, b in pairs):
            return re.compile(f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+|\n")
        # No piece goes on behind a word either: marks, then symbols, then letters and digits.
        return re.compile(rf"{MARK}*(?:[^\w{MARK}{line}]|_)*[^\W_]+|{MARK}+(?:[^\w{MARK}{line}]|_)*|(?:[^\w{MARK}{line}]|_)+|\n")

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a normalised text; of equal scores the longer last piece wins."""
        size = len(text)
        best = [0.0] + [-math.inf] * size
        back: list[tuple[int, int]] = [(0, -1)] * (size + 1)
        known = self.single.issuperset(text)
        reached = 0  # every position up to here has its final score
        for last, (length, score, piece) in self.automaton.iter(text):
            if not known:
                while reached < last:
                    reached += 1
                    self._step(best, back, text, reached)
            start = last + 1 - length
            if (total := best[start] + score) > best[last + 1]:
                best[last + 1], back[last + 1] = total, (start, piece)
        while not known and reached < size:
            reached += 1
            self._step(best, back, text, reached)
        ids, end = [], size
        while end:
            start, piece = back[end]
            ids.extend(reversed(self._fallback(text[start:end])) if piece < 0 else (piece,))
            end = start
        return ids[::-1]

    def _step(self, best: list[float], back: list, text: str, end: int) -> None:
        """A character without a piece of its own may be read as unknown."""
        if text[end - 1] in self.single:
            return
        score = best[end - 1] + self.unknown_score
        if score > best[end]:
            best[end], back[end] = score, (end - 1, -1)

    def _fallback(self, character: str) -> list[int]:
        if self.id_of_byte:
            return [self.id_of_byte[b] for b in character.encode("utf-8", "replace")]
        return [self.unknown]

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit bytes; none for a null or empty text."""
        if not text:
            return b""
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if self.parts is None:
            return packed(self.segment(text))
        # Words are remembered; what is long is rare and would fill the memory.
        return b"".join(
            [self.part[x] if len(x) <= 64 else packed(self.segment(x)) for x in self.parts.findall(text)]
        )

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of a file, loaded once by each worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _mapped(df: DataFrame, steps: list[tuple[str, str, str, Callable[[pa.Array], pa.Array]]]) -> DataFrame:
    """`df` with a column `added` for each step (column, added, kind, convert), which maps one Arrow array to another.

    A step may use what an earlier one added; all steps are done in one pass. Batches are cut into slices of at
    most `SLICE_BYTES` bytes of the first column (or one row), so that the results of a batch of long texts are
    never held together.
    """
    kept = [c for c in df.columns if c not in {added for _, added, _, _ in steps}]
    made = [T.StructField(added, T._parse_datatype_string(kind)) for _, added, kind, _ in steps]
    schema = T.StructType([*(df.schema[c] for c in kept), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, steps[0][0], SLICE_BYTES):
                arrays = dict(zip(part.schema.names, part.columns))
                for column, added, _, convert in steps:
                    arrays[added] = convert(arrays[column])
                yield pa.RecordBatch.from_arrays([arrays[f.name] for f in schema], names=schema.names)

    return df.mapInArrow(run, schema)


def _encoded(path: str) -> Callable[[pa.Array], pa.Array]:
    def convert(texts: pa.Array) -> pa.Array:
        encode = piece_model(path).encode_packed
        coded = [None if t is None else encode(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(c or b"") // 4 for c in coded)])
        offsets = pa.array(ends, pa.int32(), mask=np.array([c is None for c in coded] + [False]))
        values = pa.array(np.frombuffer(b"".join(c for c in coded if c), "<i4"))
        return pa.ListArray.from_arrays(offsets, values)

    return convert


def _decoded(path: str) -> Callable[[pa.Array], pa.Array]:
    def convert(lists: pa.Array) -> pa.Array:
        model = piece_model(path)
        ids = lists.flatten().to_numpy(zero_copy_only=False).tolist()
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends, there = np.concatenate([[0], np.cumsum(lengths)]).tolist(), lists.is_valid().to_pylist()
        return pa.array([model.decode(ids[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], there)], pa.string())

    return convert


def encode_texts(docs: DataFrame, path: str, column: str = "text", added: str = "ids") -> DataFrame:
    """`docs` with the ids of `column`; a null text has null ids, an empty one none.

    A column that is already called `added` is replaced; all other columns stay.
    """
    return _mapped(docs, [(column, added, "array<int>", _encoded(path))])


def decode_ids(coded: DataFrame, path: str, column: str = "ids", added: str = "decoded") -> DataFrame:
    """`coded` with the text of the ids in `column`; null ids have a null text.

    Decoding an encoded text gives the text back, but that a literal word mark (U+2581) becomes a space.
    """
    return _mapped(coded, [(column, added, "string", _decoded(path))])


def encode_and_decode(
    docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """`encode_texts`, and `decode_ids` of what it gives, in one pass over the texts."""
    return _mapped(docs, [(column, ids, "array<int>", _encoded(path)), (ids, decoded, "string", _decoded(path))])
