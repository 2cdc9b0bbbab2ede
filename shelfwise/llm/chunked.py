"""Tokenise long texts piece by piece, encoding each distinct piece once.

A byte-pair encoder works on pre-tokens, and no pre-token of the patterns used here
reaches across a single space between two other characters. So a text may be cut at
such spaces, each following space staying with the piece behind it, and the pieces'
ids joined are the ids of the text. Most pieces repeat, so a bounded memory of
encoded pieces does most of the work.

The added tokens of a tokenizer file are found first, in the whole text, and the
stretches between them are encoded by pieces.

``BatchEncoder`` does this for many texts at once: Arrow cuts them and finds the distinct
pieces of the batch, which are looked up together; only pieces that are new are encoded
one by one, and the ids of the texts are gathered from those of the distinct pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: What must be absent for each space to stand alone: pairs, and rarer white space.
_RUNS = ["  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]

#: Characters encoded at a time, unless told otherwise.
CHARACTERS = 1 << 20
#: Letters of ASCII and Latin-1 alone: composed, and lower-cased one by one.
_LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def pieces_with_spaces(text: str) -> list[str]:
    """The text in pieces, each but the first beginning with its space.

    Where white space touches white space the run stays in one piece, since a
    pre-token may hold several of them.
    """
    runs = text[0].isspace() or text[-1].isspace() or any(run in text for run in _RUNS)
    parts = _BETWEEN.split(text) if runs else text.split(" ")
    return parts[:1] + [" " + part for part in parts[1:]]


def pieces_without_spaces(text: str) -> list[str]:
    """The text's words, for encoders that drop white space.

    Python also splits at four separators which are not white space to the encoders.
    """
    if any(separator in text for separator in "\x1c\x1d\x1e\x1f"):
        return [part for part in text.replace("\n", " ").split(" ") if part]
    return text.split()


class PieceEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``words`` gives the pre-tokens of a piece and ``tokenise`` the ids of one
    pre-token; ``lowers`` tells that ``words`` lower-cases them. At most twice ``remembered`` pieces stay in memory: when the young half
    is full it becomes the old half, and pieces met again move back.
    """

    def __init__(
        self,
        split: Callable[[str], list[str]],
        words: Callable[[str], list[str]],
        tokenise: Callable[[str], list[int]],
        remembered: int = 250_000,
        lowers: bool = False,
    ):
        self.split, self.words, self.tokenise, self.remembered = split, words, tokenise, remembered
        self.lowers = lowers
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            words = self.words(piece)
            if words == [piece]:
                ids = array("I", self.tokenise(piece)).tobytes()
            else:
                ids = b"".join([self[word] for word in words])
        self[piece] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > self.remembered:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))


class AddedTokens:
    """Ids of texts that may hold a tokenizer file's added tokens.

    Such a token gets its own id wherever its string stands, and each stretch between
    two of them is encoded as a text. Of tokens that begin at one place the longest
    counts. Only tokens that are matched as they are written, whatever stands beside
    them, are known here; others in the file raise an error.
    """

    def __init__(self, encode: PieceEncoder, tokenizer):
        self.encode, self.model = encode, tokenizer.model
        added = tokenizer.get_added_tokens_decoder()
        normalises = tokenizer.normalizer is not None
        for token in added.values():
            if token.single_word or token.lstrip or token.rstrip or (token.normalized and normalises):
                raise ValueError(f"added token {token.content!r} is not matched as written")
        self.ids = {token.content: array("I", [i]).tobytes() for i, token in added.items()}
        longest_first = sorted(self.ids, key=lambda content: (-len(content), content))
        self.find = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None

    def __call__(self, text: str | None) -> bytes:
        if not text or not any(content in text for content in self.ids):
            return self.encode(text)
        parts = self.find.split(text)
        return b"".join([self.ids[part] if i % 2 else self.encode(part) for i, part in enumerate(parts)])


class _Known:
    """Pieces and their ids: piece ``i`` has ``data[starts[i] : starts[i] + sizes[i]]``."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.data = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int32)

    def find(self, words: pa.Array) -> np.ndarray:
        """The places of words, -1 for unknown ones."""
        return np.array(pc.index_in(words, value_set=self.words).fill_null(-1), np.int64)

    def add(self, words: pa.Array, data: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.append(data, sizes)

    def append(self, data: np.ndarray, sizes: np.ndarray) -> None:
        starts = (len(self.data) + np.cumsum(sizes) - sizes).astype(np.int32)
        self.starts, self.sizes = np.append(self.starts, starts), np.append(self.sizes, sizes)
        self.data = np.append(self.data, data)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at ``places``, one after another, and their numbers."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[places] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.data[at], sizes


class _Words:
    """Ids of pre-tokens, many at once: a pre-token's place leads to its ids.

    ``characters`` gives the string that the model reads for a pre-token. With more than
    ``remembered`` pre-tokens all are forgotten before the next call.
    """

    def __init__(self, model, characters: Callable[[list[str]], list[str]], remembered: int):
        self.tokenise, self.characters, self.remembered = model.tokenize, characters, remembered
        self.places: dict[str, int] = {}
        self.known = _Known()

    def find(self, words: list[str]) -> np.ndarray:
        """The places of pre-tokens among ``known``; new ones go through the model first."""
        if len(self.places) > self.remembered:
            self.places, self.known = {}, _Known()
        new = [word for word in dict.fromkeys(words) if word not in self.places]
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        characters, sizes, data = self.characters(new), array("i"), array("I")
        for start in range(0, len(new), 1024):  # few of the model's tokens are held at a time
            tokens = list(map(self.tokenise, characters[start : start + 1024]))
            sizes.extend(map(len, tokens))
            data.extend([token.id for found in tokens for token in found])
        self.known.append(np.frombuffer(data, np.uint32), np.frombuffer(sizes, np.int32))
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


class BatchEncoder:
    """Ids of many texts as little-endian unsigned 32-bit integers.

    ``one`` encodes single texts: those that Arrow does not cut, with runs of white space
    or added tokens. Memory is bounded: when the young half holds ``remembered`` pieces
    it becomes the old half, and pieces met again are taken over. New pieces are made of
    pre-tokens, of which as many are remembered; all new ones of a call are found
    together.
    """

    def __init__(self, one: AddedTokens, remembered: int = 150_000):
        self.one, self.remembered = one, remembered
        one.encode.remembered = min(one.encode.remembered, remembered // 8)
        self.spaced = one.encode.split is pieces_with_spaces
        self.split, self.lowers = one.encode.words, one.encode.lowers
        self.words = _Words(one.model, all_byte_characters, remembered)
        self.young, self.old = _Known(), _Known()

    def _plain(self, text: str) -> bool:
        if not text or "\x01" in text or any(content in text for content in self.one.ids):
            return False
        return not self.spaced or not (text[0].isspace() or text[-1].isspace() or any(run in text for run in _RUNS))

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and their numbers.

        Arrow takes apart the usual piece: Latin letters, behind a space where spaces are
        kept, with a comma or a stop or without. Others are split one by one.
        """
        stems = pc.ascii_rtrim(pieces, ",.")
        letters = pc.ascii_ltrim(stems, " ") if self.spaced else stems
        marks = np.array(pc.subtract(pc.binary_length(pieces), pc.binary_length(stems)))
        usual = np.array(pc.match_substring_regex(letters, _LATIN)) & (marks <= 1)
        stems = stems.filter(pa.array(usual))
        stems = (pc.utf8_lower(stems) if self.lowers else stems).dictionary_encode()
        parts = [self.split(piece) if piece else [] for piece in pieces.filter(pa.array(~usual)).to_pylist()]

        named = stems.dictionary.to_pylist()
        places = self.words.find([*named, ",", ".", *chain.from_iterable(parts)])
        counts = 1 + marks
        counts[~usual] = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(counts)
        marked = usual & (marks == 1)
        at, mark_at = (ends - counts)[usual], ends[marked] - 1
        words = np.full(ends[-1] if len(ends) else 0, -1, np.int64)
        words[at] = places[stems.indices.to_numpy()]
        comma = np.array(pc.ends_with(pieces, ","))
        words[mark_at] = places[np.where(comma[marked], len(named), len(named) + 1)]
        words[words < 0] = places[len(named) + 2 :]
        data, sizes = self.words.known.ids(words)
        return data, np.diff(np.append(0, np.cumsum(sizes))[ends], prepend=0).astype(np.int32)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the distinct pieces are among the young ones, all of which they then are."""
        if len(self.young.words) > self.remembered:
            self.young, self.old = _Known(), self.young
        places = self.young.find(pieces)
        unknown = np.flatnonzero(places < 0)
        before = self.old.find(pieces.take(pa.array(unknown)))
        again, new = unknown[before >= 0], unknown[before < 0]
        size = len(self.young.words)
        self.young.add(pieces.take(pa.array(again)), *self.old.ids(before[before >= 0]))
        words = pieces.take(pa.array(new))
        self.young.add(words, *self._new(words))
        places[again] = size + np.arange(len(again))
        places[new] = size + len(again) + np.arange(len(new))
        return places

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        plain = [i for i, text in enumerate(texts) if text and self._plain(text)]
        found = [b""] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            found[i] = self.one(texts[i])
        if not plain:
            return found
        chosen = pa.array([texts[i] for i in plain], pa.large_string())
        if self.spaced:
            cut = pc.split_pattern(pc.replace_substring(chosen, " ", "\x01 "), "\x01")
        else:
            cut = pc.split_pattern(pc.replace_substring(chosen, "\n", " "), " ")
        pieces = cut.flatten().dictionary_encode()
        places = self._places(pieces.dictionary)
        data, sizes = self.young.ids(places[pieces.indices.to_numpy()])
        ends = np.append(0, np.cumsum(sizes))[cut.offsets.to_numpy()]
        whole = memoryview(data.astype("<u4", copy=False)).cast("B")
        for i, start, end in zip(plain, ends.tolist(), ends[1:].tolist()):
            found[i] = bytes(whole[4 * start : 4 * end])
        return found


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes in ascending
    order for the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


_BYTE_TABLE = dict(enumerate(byte_characters()))


def to_byte_characters(word: str) -> str:
    if word.isascii() and word.isalpha():
        return word
    plain = word[1:] if word[0] == " " else word
    if plain.isascii() and plain.isalpha():
        return word.replace(" ", _BYTE_TABLE[32])
    return word.encode().decode("latin-1").translate(_BYTE_TABLE)


def all_byte_characters(words: list[str]) -> list[str]:
    """``to_byte_characters`` of each word; most are letters with or without a space."""
    space = _BYTE_TABLE[32]
    return [
        word if (word.isalpha() and word.isascii())
        else space + word[1:] if word[0] == " " and word[1:].isalpha() and word.isascii()
        else to_byte_characters(word)
        for word in words
    ]


def _words(find: Callable[[str], list[str]], piece: str) -> list[str]:
    """Pre-tokens of a piece: the search only where it is not a word with a comma or stop."""
    word = piece[1:] if piece[0] == " " else piece
    if word.isalpha():
        return [piece]
    if piece[-1] in ",." and word[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return find(piece)


def byte_level_words(pattern: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a piece by ``pattern``, which must keep letters together."""
    import regex

    find = regex.compile(pattern).findall
    return partial(_words, find)


def _by_model(model) -> Callable[[str], list[int]]:
    """Ids of one pre-token by the model alone: a whole ``encode`` call on so short a
    text costs three times as much."""
    return lambda word: [token.id for token in model.tokenize(to_byte_characters(word))]


def load(tokenizer_file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


def byte_level_encoder(tokenizer, pattern: str) -> PieceEncoder:
    """An encoder over a loaded byte-level tokenizer that keeps white space.

    Strings of added tokens are plain text; see ``AddedTokens``.
    """
    return PieceEncoder(pieces_with_spaces, byte_level_words(pattern), _by_model(tokenizer.model))


#: The pre-token pattern of the lower-casing tokenizer file.
LOWER_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def lower_case_encoder(tokenizer) -> PieceEncoder:
    """An encoder over a loaded tokenizer that composes, lower-cases and drops space.

    Strings of added tokens are plain text; see ``AddedTokens``.
    """
    import regex

    normal = tokenizer.normalizer.normalize_str
    find = regex.compile(LOWER_PATTERN).findall

    def words(piece: str) -> list[str]:
        # Printable Latin-1 text is composed already and holds no white space.
        plain = piece.isprintable() and (piece.isascii() or max(piece) < "\u0100")
        piece = piece.lower() if plain else normal(piece).strip(" ")
        return _words(find, piece) if piece else []

    return PieceEncoder(pieces_without_spaces, words, _by_model(tokenizer.model), lowers=True)


def rows(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few hundred in memory at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def encoded_rows(
    batches: Iterable[pa.RecordBatch], encode: Callable[[list], list[bytes]], most_characters: int = CHARACTERS
) -> Iterator[tuple]:
    """``(doc_id, ids)`` of rows ``(doc_id, text)``, encoded so many characters at a time."""
    names, texts, size = [], [], 0
    for doc_id, text in rows(batches, ["doc_id", "text"]):
        names.append(doc_id)
        texts.append(text)
        size += len(text or "")
        if size >= most_characters or len(texts) >= 8192:
            yield from zip(names, encode(texts))
            names, texts, size = [], [], 0
    yield from zip(names, encode(texts))
    pa.default_memory_pool().release_unused()


def batches_of(
    rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 2048, most_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of tuples, closed after so many rows or bytes of their binary values."""
    held: list[tuple] = []
    size = 0
    wide = [i for i, field in enumerate(schema) if pa.types.is_binary(field.type) or pa.types.is_string(field.type)]
    for row in rows:
        held.append(row)
        size += sum(len(row[i]) for i in wide if row[i] is not None)
        if len(held) >= most_rows or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*held), schema)], schema=schema
    )
