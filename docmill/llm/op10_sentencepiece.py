"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

Merge-type BPE has two properties that replace the merging loop: every prefix of a text has one
last token, and a row of tokens is the encoding exactly if each neighbouring pair is (encoding the
pair's joined text gives the pair back). So the table stores, for each prefix, its last token: of
the tokens that an Aho-Corasick automaton finds ending there, the one that is compatible with the
last token of the prefix before it. The ids are then read backwards.

No piece holds the word mark behind another character, and characters in no piece never merge, so
texts are cut at word marks and line ends, and short stretches are encoded once per worker.

Defined cases: a null or empty text gives the begin and end ids only and decodes to the empty text;
unknown characters become byte pieces; repeated rows are encoded each on its own; other columns of
the input take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from docmill.llm.common import text_batches

MARK = "▁"
MODEL_LIMIT = 64 << 20  # bytes of a model file that may be sent to the workers
CACHE_ENTRIES = 300_000
CACHE_LENGTH = 64
PAIR_ENTRIES = 2_000_000
UNKNOWN = -1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        length = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + length]
        at += length


class PieceTable:
    """Pieces of one model and the prefix-table encoder. Small: tens of thousands of pieces."""

    def __init__(self, model: bytes):
        import ahocorasick

        pieces, options, trainer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece[1].decode(), score, piece.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                options = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("a BPE model with byte fallback is needed")
        if options.get(2) or not options.get(3, 1) or options.get(4, 1) or not options.get(5, 1):
            raise ValueError("a model without normalization, with a dummy prefix, is needed")
        kinds = {"unknown": 2, "control": 3, "user": 4, "unused": 5, "byte": 6}  # fixed by the format
        if any(kind in (kinds["user"], kinds["unused"]) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.byte_pieces: set[int] = set()
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == 1:
                self.ids[piece], self.scores[piece] = i, score
                self.bytes_of.append(piece.replace(MARK, " ").encode())
            elif kind == kinds["byte"]:
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.byte_pieces.add(i)
                self.bytes_of.append(bytes([value]))
            elif kind == kinds["unknown"]:
                self.bytes_of.append(" ⁇ ".encode())  # how unknown ids are shown
            else:
                self.bytes_of.append(b"")
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("pieces that go over a word mark are not supported")
        self.text_of = {i: piece for piece, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:  # pieces that merging never yields are left out
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        alphabet = {c for piece in self.ids for c in piece}
        stop = "" if "\n" in alphabet else "\n"
        self.cutter = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if stop else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Encoding by its definition, for the few characters of one or two pieces: join the pair
        with the best score, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            a, b = self.text_of[left], self.text_of[right]
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return found

    def encode_stretch(self, text: str) -> bytes:
        """Ids of a stretch as little-endian 32-bit numbers, by the prefix table."""
        known = self.pairs
        last = [UNKNOWN] * (len(text) + 1)
        lengths = [1] * (len(text) + 1)
        filled = 0
        for at, (length, token) in self.automaton.iter(text):
            if at + 1 == filled:
                continue  # this prefix has its last token
            start = at + 1 - length
            before = last[start]
            if start and before != UNKNOWN:
                fits = known.get((before, token))
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[at + 1], lengths[at + 1], filled = token, length, at + 1
        out: list[int] = []
        at = len(text)
        while at:
            if last[at] == UNKNOWN:
                out.extend(self.byte_id[b] for b in reversed(text[at - 1].encode("utf-8", "replace")))
            else:
                out.append(last[at])
            at -= lengths[at]
        return struct.pack(f"<{len(out)}I", *reversed(out))

    def encode(self, text: str) -> bytes:
        """Begin id, ids of the whole text, end id."""
        parts = [struct.pack("<I", self.begin)]
        if text:
            known = self.known
            for stretch in self.cutter.findall(MARK + text.replace(" ", MARK)):
                ids = known.get(stretch)
                if ids is None:
                    ids = self.encode_stretch(stretch)
                    if len(stretch) <= CACHE_LENGTH:
                        if len(known) >= CACHE_ENTRIES:
                            known.clear()
                        known[stretch] = ids
                parts.append(ids)
        parts.append(struct.pack("<I", self.end))
        return b"".join(parts)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, the dummy space at the start dropped, control ids silent.
        Bytes that are no character become one replacement character each."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        first = next((i for i in ids if self.bytes_of[i]), None)
        dummy = first is not None and first not in self.byte_pieces and first in self.text_of
        return text[1:] if dummy and text.startswith(" ") else text

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and i in self.byte_pieces:
                run += self.bytes_of[i]
                continue
            while run:
                for length in (1, 2, 3, 4):
                    try:
                        out.append(run[:length].decode())
                        run = run[length:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


_tables: dict[str, PieceTable] = {}


def piece_table(model: bytes) -> PieceTable:
    """One table per worker and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = PieceTable(model)
    return _tables[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read(MODEL_LIMIT + 1)
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"the model is larger than {MODEL_LIMIT} bytes")
    return model


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text (array of int, with begin and end ids) and the text decoded from
    them: ``id_col``, ``ids``, ``decoded``."""
    schema = T.StructType([
        docs.schema[id_col],
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ])
    return _apply(docs, model_path, id_col, text_col, schema, _ids_columns)


def encode_digests(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256 and decoded_sha256 of :func:`encode`'s columns, without
    sending the ids out of the workers."""
    schema = T.StructType([
        docs.schema[id_col],
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ])
    return _apply(docs, model_path, id_col, text_col, schema, _digest_columns)


def _ids_columns(encoded: Iterator[tuple[bytes, list[int], str]]) -> list[list]:
    ids, texts = [], []
    for _, numbers, text in encoded:
        ids.append(numbers)
        texts.append(text)
    return [ids, texts]


def _digest_columns(encoded: Iterator[tuple[bytes, list[int], str]]) -> list[list]:
    counts, ids, texts = [], [], []
    for packed, numbers, text in encoded:
        counts.append(len(numbers))
        ids.append(hashlib.sha256(packed).hexdigest())
        texts.append(hashlib.sha256(text.encode()).hexdigest())
    return [counts, ids, texts]


def _apply(docs, model_path, id_col, text_col, schema, columns) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    arrow = None

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        nonlocal arrow
        arrow = arrow or to_arrow_schema(schema)
        table = piece_table(model.value)

        def encoded(texts):
            for text in texts:
                packed = table.encode(text.as_py() or "")
                numbers = list(struct.unpack(f"<{len(packed) // 4}I", packed))
                yield packed, numbers, table.decode(numbers)

        for batch in text_batches(batches, 2_000, 8 << 20):
            made = columns(encoded(batch.column(1)))
            arrays = [batch.column(0).cast(arrow.field(0).type)]
            arrays += [pa.array(v, type=f.type) for v, f in zip(made, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(work, schema)
