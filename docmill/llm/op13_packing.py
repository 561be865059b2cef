"""Packing of tokenized documents into sequences of a fixed length by first-fit decreasing.

Every whole text is tokenized, one end id follows, and the ids are cut into pieces: full ones of
``width`` ids, which are sequences by themselves, and the rest of the document. The rests are dealt
into randomised groups of about ``group`` rows, by a hash of a row number so that equal rows part.
Each group is packed by itself: longest rest first, into the first sequence that has room for it,
which a tournament tree finds (a node holds the largest room below it). Sequences whose padding is
then above ``slack`` ids are closed up: their pieces are laid end to end and cut at every ``width``
ids. So at most ``slack`` ids of a sequence are padding, but for one sequence a group.

A task holds one group (about ``group * width`` ids at most), whatever the size of the table and of
a document; long texts are tokenized in slices cut before white space, where no token can cross.

Defined cases: a null text counts as empty and has the end id alone; a null or repeated id is kept as
it is, and repeated rows are documents each; strings of special tokens in a text are ordinary text;
an empty table gives no pieces. Extra columns take no part. Sequence ids are unique and not
consecutive.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docmill.llm.common import stored, text_batches

WIDTH = 2048
GROUP = 4096
SLACK = WIDTH // 64
END = 1
TOKENIZER_LIMIT = 64 << 20
SLICE = 1 << 20  # letters tokenized at once
KNOWN = 1 << 19  # stretches remembered per worker
LONG = 64  # letters of a stretch that is remembered
# The letters of Unicode's White_Space property.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(rf"(?<=[^{_BLANK}])(?=[{_BLANK}])")
# Words of Latin letters that end at an ASCII sign, white space or the end of the text; else all up to
# the next white space.
_WORD = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]++"
_PLAIN = re.compile(f" ?{_WORD}")
_STRETCH = re.compile(rf"[{_BLANK}]*+(?:{_WORD}(?=[\x00-@\[-`{{-\x7f{_BLANK}]|\Z)|[^{_BLANK}]++)|[{_BLANK}]++")


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as file:
        made = file.read(TOKENIZER_LIMIT + 1)
    if len(made) > TOKENIZER_LIMIT:
        raise ValueError(f"the tokenizer is larger than {TOKENIZER_LIMIT} bytes")
    return made


def tokenizer(made: bytes):
    """The tokenizer of a file; a task uses one core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_buffer(made)
    found.encode_special_tokens = True
    return found


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` in parts of ``size`` letters or a little more, cut before white space behind another
    letter: there a token of a byte-level tokenizer always ends."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Ids:
    """Ids of whole texts (little-endian unsigned 32-bit) by the tokenizer. A byte-level tokenizer
    splits texts before white space behind another letter, and behind a word before a sign. So texts are
    looked up in such stretches, and only those not met lately are tokenized; plain words, which are
    never split further, by the tokenizer's model alone."""

    def __init__(self, made: bytes):
        self.tokenizer, self.known = tokenizer(made), {}
        letters = [chr(c) for c in range(0x20, 0x250) if _PLAIN.fullmatch(chr(c))] + [" "]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = str.maketrans({c: split(c)[0][0] for c in letters})

    def _tokenized(self, stretches: list[str]) -> Iterator[tuple[str, bytes]]:
        tokenize, others = self.tokenizer.model.tokenize, []
        for stretch in stretches:
            if _PLAIN.fullmatch(stretch):
                ids = [token.id for token in tokenize(stretch.translate(self.letters))]
                yield stretch, struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(stretch)
        for stretch, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            yield stretch, struct.pack(f"<{len(found.ids)}I", *found.ids)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        if sum(map(len, texts)) <= 4 * SLICE:
            yield from self._looked_up(texts)
            return
        for text in texts:
            yield b"".join(b"".join(self._looked_up([part])) for part in slices(text))

    def _looked_up(self, texts: list[str]) -> Iterator[bytes]:
        cut = [_STRETCH.findall(text) for text in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        self.known.update(self._tokenized(new))
        for stretches in cut:
            yield b"".join(map(self.known.__getitem__, stretches))
        for stretch in new:
            if len(stretch) > LONG:
                del self.known[stretch]


_ids: dict[bytes, Ids] = {}


def ids_by(made: bytes) -> Ids:
    """What a worker knows of a tokenizer, over all its tasks."""
    if made not in _ids:
        _ids.clear()
        _ids[made] = Ids(made)
    return _ids[made]


class RoomTree:
    """Tournament tree over sequences: every node holds the largest room of its side."""

    def __init__(self, sequences: int, width: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.rooms = [width] * (2 * self.leaves)

    def take(self, length: int) -> tuple[int, int]:
        """Put ``length`` ids into the first sequence with room; its number and its room before."""
        rooms, node = self.rooms, 1
        while node < self.leaves:
            node *= 2
            if rooms[node] < length:
                node += 1
        room = rooms[node]
        rooms[node] = room - length
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            rooms[node] = max(rooms[2 * node], rooms[2 * node + 1])
        return leaf, room


def padding(filled: int, width: int) -> int:
    """Padding ids behind ``filled`` ones; a power of two is taken as it is."""
    return 0 if filled & (filled - 1) == 0 else width - filled


def first_fit_decreasing(lengths: list[int], width: int) -> list[tuple[int, int]]:
    """(sequence, offset) of every length, none above ``width``; of equal lengths the first comes
    first."""
    places = [(0, 0)] * len(lengths)
    tree = RoomTree(len(lengths), width)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        sequence, room = tree.take(lengths[item])
        places[item] = (sequence, width - room)
    return places


def pack_group(lengths: list[int], width: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset) of every piece of a group."""
    places = first_fit_decreasing(lengths, width)
    filled: dict[int, int] = {}
    for length, (sequence, _) in zip(lengths, places, strict=True):
        filled[sequence] = filled.get(sequence, 0) + length
    loose = {s for s, n in filled.items() if padding(n, width) > slack}
    pieces = [
        (item, 0, lengths[item], *place) for item, place in enumerate(places) if place[0] not in loose
    ]
    sequence, offset = len(lengths), 0  # numbers from here on are not in use
    for item, place in sorted(enumerate(places), key=lambda p: p[1]):
        start = 0
        while place[0] in loose and start < lengths[item]:
            length = min(lengths[item] - start, width - offset)
            pieces.append((item, start, length, sequence, offset))
            start, offset = start + length, offset + length
            if offset == width:
                sequence, offset = sequence + 1, 0
    return pieces


def tokenized(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, id_col: str = "doc_id",
              text_col: str = "text", end: int = END) -> DataFrame:
    """Pieces of at most ``width`` ids: ``id_col``, ``start``, ``length``, ``doc_tokens`` and ``ids``
    (little-endian unsigned 32-bit)."""
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    schema = T.StructType([
        docs.schema[id_col], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, ids = to_arrow_schema(schema), ids_by(sent.value)
        for batch in text_batches(batches, 1_000, 4 << 20):
            rows, starts, lengths, totals, pieces = [], [], [], [], []
            for row, found in enumerate(ids.of([text or "" for text in batch.column(1).to_pylist()])):
                whole = found + struct.pack("<I", end)
                for start in range(0, len(whole), 4 * width):
                    piece = whole[start : start + 4 * width]
                    rows.append(row)
                    starts.append(start // 4)
                    lengths.append(len(piece) // 4)
                    totals.append(len(whole) // 4)
                    pieces.append(piece)
            names = batch.column(0).take(pa.array(rows, type=pa.int64())).cast(arrow.field(0).type)
            arrays = [names, *(pa.array(v, type=f.type) for v, f in zip([starts, lengths, totals, pieces], list(arrow)[1:], strict=True))]
            whole = pa.RecordBatch.from_arrays(arrays, schema=arrow)
            for at in range(0, len(rows), GROUP):
                yield whole.slice(at, GROUP)

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def pack(pieces: DataFrame, width: int = WIDTH, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """Place stored ``pieces`` (see :func:`tokenized`): adds ``sequence_id`` and ``offset``; a rest
    may come back in several pieces."""
    number = F.monotonically_increasing_id()
    full = pieces.where(F.col("length") == width).withColumn("sequence_id", number * 2)
    full = full.withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where(F.col("length") < width)
    groups = max(1, -(-rests.count() // group))
    dealt = rests.withColumn("sequence_id", number)
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    schema = full.schema

    def place(key, table):
        from pyspark.sql.pandas.types import to_arrow_schema

        table = table.drop_columns(["_group"]).combine_chunks().sort_by("sequence_id")
        found = pack_group(table["length"].to_pylist(), width, slack)
        items, starts, lengths, sequences, offsets = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
        taken = table.take(pa.array(items))
        ids = [
            whole[4 * a : 4 * (a + n)]
            for whole, a, n in zip(taken["ids"].to_pylist(), starts.tolist(), lengths.tolist(), strict=True)
        ]
        # odd numbers: full pieces have the even ones
        sequence_ids = ((key[0].as_py() << 24) + sequences) * 2 + 1
        made = {
            "start": pa.array(taken["start"].to_numpy() + starts), "length": pa.array(lengths), "ids": pa.array(ids, pa.binary()),
            "sequence_id": pa.array(sequence_ids), "offset": pa.array(offsets),
        }
        arrow = to_arrow_schema(schema)
        return pa.Table.from_arrays([made.get(f.name, taken[f.name] if f.name in taken.column_names else None) for f in arrow], schema=arrow)

    return full.unionByName(dealt.groupBy("_group").applyInArrow(place, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, group: int = GROUP,
                   slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: ``id_col``, ``start``, ``length``,
    ``doc_tokens``, ``ids``, ``sequence_id``, ``offset``."""
    return pack(stored(tokenized(docs, tokenizer_path, width, id_col, text_col)), width, group, slack)


def sequences(packed: DataFrame, width: int = WIDTH, pad: int = 0) -> DataFrame:
    """The training rows: ``sequence_id``, ``ids`` (array of int, padded with ``pad`` to ``width``
    unless their number is a power of two) and ``used`` (ids that are not padding)."""
    schema = "sequence_id long, ids array<int>, used int"

    def join(table):
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), dtype="<u4").astype(np.int32)
        row = np.append(ids, np.full(padding(len(ids), width), pad, dtype=np.int32))
        return pa.table({
            "sequence_id": table["sequence_id"].slice(0, 1), "ids": pa.array([row], pa.list_(pa.int32())),
            "used": pa.array([len(ids)], pa.int32()),
        })

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, schema)
