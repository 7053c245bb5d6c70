"""Byte-level BPE over Arrow batches with the tokenizers library.

Texts are cut before the last blank of every gap, where no token can cross, and the ids of each
cut are remembered per worker up to a bound: words repeat, so most are looked up.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from colloquy.llm.common import Memory

#: Bytes of cuts and their ids that a worker remembers, and of one of them, about. Longer cuts are not remembered.
MEMORY, ENTRY, LONGEST = 192 << 20, 220, 48
#: Bytes of cuts and their ids that are remembered as Arrow columns; looking them up takes some four times as much for a moment.
PARTS = 32 << 20
_GAP, _ODD = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")
#: Bytes that are an ASCII letter, another ASCII mark, white space for sure, or the first of a character that is no white space for sure.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([32 < b < 127 for b in range(256)]) & ~_LETTER
_SPACE = np.array([b in b" \t\n\r" for b in range(256)])
_SOLID = _LETTER | _MARK | np.array([0xC3 <= b <= 0xE0 or 0xE4 <= b <= 0xF4 for b in range(256)])


def cut_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where cuts start in the UTF-8 bytes of texts that lie between ``bounds``: places that no piece reaches across, found without reading further than the neighbours.

    These are the starts of texts; a space behind what is none, or a blank before what is none; a mark behind a letter; and what follows a lone line feed.
    Where a byte does not tell what its character is, there is no cut.
    """
    at = np.zeros(len(data) + 1, bool)
    if len(data):
        solid, letter = _SOLID[data], _LETTER[data]
        starts, blank, feed = np.zeros(len(data) + 1, bool), data == 32, data == 10
        starts[bounds] = True
        before = solid.copy()       # the byte ends a character that is no white space
        before[data >= 0xC3] = False
        # The second byte of U+00C0 to U+07FF, of which U+00C0 to U+02BF are letters but for two signs.
        before[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        letter[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xCA) & ((data[:-1] != 0xC3) | (data[1:] & 0x1F != 0x17))
        lone = feed.copy()
        lone[1:] &= before[:-1] | starts[1:-1]
        at[1:-1] = before[:-1] & _SPACE[data[1:]] | letter[:-1] & _MARK[data[1:]] | lone[:-1] & solid[1:]
        at[:-2] |= blank[:-1] & solid[1:] & ~starts[1:-1]
        at |= starts
    return np.flatnonzero(at[:-1])


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from code point 256 on (fixed values of the format)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def from_ranks(lines: Iterator[bytes]) -> Tokenizer:
    """A tokenizer for a rank file: a piece that is a token stays whole, else the pair whose joined bytes rank first is merged.

    A merge is listed for every way to cut a token into two tokens, in the order of ranks, so that any
    neighbours whose bytes make up a token can merge.
    """
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    chars = byte_chars()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(shown[token[:i]], shown[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    made = Tokenizer(models.BPE(vocab={shown[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    made.decoder = decoders.ByteLevel()
    return made


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """A tokenizer from a ``.json`` or ``.tiktoken`` file that every machine has at ``path``."""
    if path.endswith(".json"):
        made = Tokenizer.from_file(path)
    else:
        with open(path, "rb") as lines:
            made = from_ranks(lines)
        made.encode_special_tokens = True
    return made


class _Cuts(dict):
    """Ids of cuts, as little-endian bytes; the entries are few enough for half of ``MEMORY``, and what is still asked for moves on."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.most, self.encoder = MEMORY // 2 // ENTRY, encoder
        self.code, self.tokenize, self.blank = encoder.code, encoder.model.tokenize, encoder.chars[32]

    def __missing__(self, cut: str) -> bytes:
        if len(cut) > LONGEST:
            return self.encoder.long(cut)
        ids = self.old.get(cut)
        if ids is None:
            if cut.isascii() and cut.isalpha():     # letters are one piece
                ids = array(self.code, [token.id for token in self.tokenize(self.blank + cut)]).tobytes()
            else:
                ids = self.encoder.cut(cut)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[cut] = ids
        return ids


class Encoder:
    """Whole texts to ids, as the library gives them without special tokens."""

    #: The pattern that byte-level vocabularies split texts by (a fixed value of the format).
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.model, self.chars = self.tokenizer.model, byte_chars()
        # Added tokens that the library finds in texts; a text with one is left to it as a whole.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (t.special and self.tokenizer.encode_special_tokens)]
        self.table = {chr(b): c for b, c in enumerate(self.chars) if b < 128}
        self.ascii = str.maketrans(self.table)
        self.code = "H" if self.width == "<u2" else "I"
        self.pieces, self.cuts = Memory(self._piece, MEMORY // 8, longest=LONGEST), _Cuts(self)
        self.parts, self.part_ids = pa.array([], pa.string()), pa.array([], pa.binary())        # what ``column`` remembers

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece.translate(self.ascii) if piece.isascii() else "".join(map(self.chars.__getitem__, piece.encode()))
        return array(self.code, [token.id for token in self.model.tokenize(shown)]).tobytes()

    def long(self, cut: str) -> bytes:
        return self._whole(" " + cut)

    def cut(self, cut: str) -> bytes:
        """Ids of a cut, which is given without its leading blank."""
        if cut.isalpha():
            return array(self.code, [token.id for token in self.model.tokenize(self.chars[32] + "".join(map(self.chars.__getitem__, cut.encode())))]).tobytes()
        word = cut.rstrip(".,;:!?")
        if word.isalpha():      # letters are one piece, and so is what follows them
            return self.cuts[word] + self.pieces[cut[len(word):]]
        return b"".join(map(self.pieces.__getitem__, self.PIECES.findall(" " + cut)))

    def __call__(self, text: str) -> bytes:
        """Ids as bytes of type ``width``."""
        if any(token in text for token in self.added):
            return self._whole(text)
        first, *cuts = text.split(" ") if _ODD.search(text) is None else _GAP.split(text)
        start = self._whole(first) if len(first) > LONGEST else b"".join(map(self.pieces.__getitem__, self.PIECES.findall(first)))
        return start + b"".join(map(self.cuts.__getitem__, cuts))

    def _part(self, part: str) -> bytes:
        """Ids of a cut with all of its characters."""
        if len(part) > LONGEST:
            return self._whole(part)
        word = part[1:] if part[0] == " " else part
        if not word.isalpha():
            return b"".join(map(self._piece, self.PIECES.findall(part)))
        if not word.isascii():
            part = "".join(map(self.chars.__getitem__, part.encode()))
        elif word is not part:
            part = self.chars[32] + word
        return array(self.code, [token.id for token in self.model.tokenize(part)]).tobytes()

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where the ids of each of ``parts`` stand in what is remembered and the second result, one behind the other."""
        found = pc.index_in(parts, value_set=self.parts)
        unknown = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        at[unknown] = len(self.parts) + np.arange(int(unknown.sum()))
        return at, pa.array(map(self._part, parts.filter(pa.array(unknown)).to_numpy(zero_copy_only=False).tolist()), pa.binary())

    def _remember(self, parts: pa.Array, at: np.ndarray, values: pa.Array) -> None:
        """Keep ``parts`` too, or alone once all together would be over ``PARTS`` bytes; long ones are left out."""
        keep = pc.less_equal(pc.binary_length(parts), LONGEST).to_numpy(zero_copy_only=False)
        fresh = keep & (at >= len(self.parts))
        over = self.parts.nbytes + self.part_ids.nbytes > PARTS
        own = keep if over else fresh
        words, ids = parts.filter(pa.array(own)), values.take(pa.array(at[own]))
        self.parts, self.part_ids = (words, ids) if over else (pa.concat_arrays([self.parts, words]), pa.concat_arrays([self.part_ids, ids]))

    def column(self, texts: pa.Array, end: bytes = b"") -> pa.BinaryArray:
        """Ids of every text of a column (null: empty), each with ``end`` behind it. Cuts are told apart by Arrow, so that each distinct one is looked up once."""
        texts = texts.fill_null("").cast(pa.string())
        last, ends = np.zeros(len(texts), np.int64), [end]      # what stands behind each text
        for token in self.added:
            found = np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False))
            if len(found):
                last[found] = len(ends) + np.arange(len(found))
                ends += [self._whole(t) + end for t in texts.take(pa.array(found)).to_pylist()]
                texts = pc.if_else(pa.array(last > 0), "", texts)
        if not len(texts):
            return pa.array([], pa.binary())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = (data or pa.py_buffer(b""))[bounds[0]:bounds[-1]]
        bounds -= bounds[0]
        at = cut_starts(np.frombuffer(data, np.uint8), bounds)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, bounds[-1]).astype(np.int32)), data).dictionary_encode()
        known, new = self._parts(coded.dictionary)
        values = pa.concat_arrays([self.part_ids, new, pa.array(ends, pa.binary())])
        stops = np.searchsorted(at, bounds[1:])
        joined = values.take(pa.array(np.insert(known[coded.indices.to_numpy()], stops, len(values) - len(ends) + last)))
        self._remember(coded.dictionary, known, values)
        stops = np.append(0, stops + np.arange(1, len(texts) + 1))
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[stops]), joined.buffers()[2]])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of every id: the byte table reversed."""
    back = {c: b for b, c in enumerate(byte_chars())}
    tokenizer = load(path)
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    added = {i for i, _ in tokenizer.get_added_tokens_decoder().items()}
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = token.encode() if i in added else bytes(back[c] for c in token)
    return table


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(byte_table(path).__getitem__, ids.tolist()))


def decode_text(ids: np.ndarray, path: str, last: bytes = b"") -> tuple[str, bytes]:
    """Text of a run of ids, and the bytes of a character that the run ends in the middle of; ``last`` is what the run before left."""
    data = last + decode_bytes(ids, path)
    keep = next((i for i in range(1, min(4, len(data) + 1)) if data[-i] >= 0xC0), 0)
    whole = keep and keep >= (2 if data[-keep] < 0xE0 else 3 if data[-keep] < 0xF0 else 4)
    cut = len(data) - (0 if whole else keep)
    return data[:cut].decode("utf-8", "replace"), data[cut:]


def spans(text: str, ids: np.ndarray, path: str) -> tuple[list[int], list[int]]:
    """Where each token starts: its byte, and the character that this byte belongs to."""
    sizes = np.fromiter((len(b) for b in map(byte_table(path).__getitem__, ids.tolist())), np.int64, len(ids))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return starts.tolist(), (char[starts].tolist() if len(ids) else [])


def arrow_map(df: DataFrame, one: Callable[[pa.RecordBatch], list[pa.Array]], schema: str) -> DataFrame:
    """``mapInArrow`` by a function of a batch that gives the columns of ``schema``."""
    def run(batches):
        for batch in batches:
            out = one(batch)
            yield pa.RecordBatch.from_arrays(out, names=names)
    names = StructType.fromDDL(schema).names
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Ids of column ``text`` for every row: ``df``'s other columns, ``ids array<int>`` and, on request, ``byte_starts`` and ``char_starts``.

    A null text is an empty one and has no ids. Columns named like the new ones are replaced.
    """
    made = ["ids", "byte_starts", "char_starts"] if offsets else ["ids"]
    kept = [c for c in df.columns if c not in made and c != text]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("text__"))

    def run(batches):
        use = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            ids = [np.frombuffer(use(t), use.width) for t in texts]
            cols = [pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))]
            if offsets:
                both = [spans(t, i, path) for t, i in zip(texts, ids)]
                cols += [pa.array([b[k] for b in both], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *cols], names=[*kept, *made])

    schema = StructType([f for f in source.schema.fields if f.name != "text__"])
    for name in made:
        schema = schema.add(name, ArrayType(IntegerType()))
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded binary``: the bytes of every row's ids (null ids: none)."""
    schema = StructType([f for f in df.schema.fields if f.name != "decoded"]).add("decoded", "binary")
    kept = [f.name for f in schema.fields[:-1]]
    where = kept.index(ids)

    def run(batches):
        for batch in batches:
            lists = batch.column(where)
            out = [decode_bytes(np.asarray(x.values, dtype=np.int64) if x.is_valid else np.zeros(0, np.int64), path) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: encode every text, decode its ids, digest both."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        use, table = encoder(path), byte_table(path)
        n, first, second = [], [], []
        for value in batch.column(1):
            ids = np.frombuffer(use(value.as_py() or ""), use.width)
            n.append(len(ids))
            first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            second.append(hashlib.sha256(b"".join(map(table.__getitem__, ids.tolist()))).hexdigest())
        return [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]

    return arrow_map(df.select(F.col(key), F.col(text)), run, f"`{key}` {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
