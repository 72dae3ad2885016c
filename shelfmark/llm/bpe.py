"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton finds
every vocabulary token in a piece.  Encoding walks from the longest match at each
place and backtracks to shorter ones; two neighbours may stand together only if
merging by rank would not have joined bytes across their border, which is worked
out once per pair and remembered.  The tokens are those that merging gives.

What a worker remembers is bounded by bytes (MEMORY) and forgotten with its task.

Defined results: a null or empty text has no tokens; special tokens are ordinary
text; texts are encoded whole, and a piece may have any length; repeated rows and
rows without doc_id are encoded like any other; an empty table gives no rows; other
columns are carried whatever their names, but ``encode`` refuses a table that has a
column of the name it is to add.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

#: Bytes of remembered pieces, remembered pairs, and characters of the longest piece that is
#: remembered; beyond these the memory starts anew, results are the same.
MEMORY, PAIRS, LONGEST = 48 << 20, 150_000, 64
#: The pre-tokenizing pattern whose pieces never cross a space before a word (fixed value).
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = regex.compile(r" \s")


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank of a .tiktoken file."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Encoder:
    """Encode and decode with the tokens of a vocabulary, in order of rank."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.rank = {token: i for i, token in enumerate(vocabulary)}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(vocabulary):
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = [len(token) for token in vocabulary]
        self.shorter = [self._shorter(token) for token in vocabulary]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: list[tuple[int, int]] = []
        self.joined: dict[tuple[int, int], int] = {}
        for i, token in enumerate(vocabulary):
            self.halves.append(self._halve(i, token))
            left, right = self.halves[-1]
            if left != i:
                self.joined[left, right] = i
        self.pieces: dict[str, list[int]] = {}
        #: Cutting before spaces is proven for this pattern alone.
        self.stretches: dict[str, list[int]] | None = {} if pattern == CUT_PATTERN else None
        self.held = 0

    def _shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        for n in range(len(token) - 1, 0, -1):
            found = self.rank.get(token[:n])
            if found is not None:
                return found
        return -1

    def _halve(self, i: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge made this one; a single byte is its own halves."""
        left = self.shorter[i]
        while left != -1:
            right = self.rank.get(token[self.lengths[left] :])
            if right is not None and left < i and right < i and self._compatible(left, right):
                return left, right
            left = self.shorter[left]
        return i, i

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between two neighbours open.

        Both tokens are taken apart in the reverse order of their merges; a pair
        across the border that would have merged before the next step closes it.
        """
        limit = len(self.vocabulary) + 1
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < limit:
                return False
            if left > right:
                limit, (_, part) = left, self.halves[left]
                if part != left:
                    left = part
                    continue
                limit, (part, _) = right + 1, self.halves[right]
                if part == right:
                    return True
                right = part
            else:
                limit, (part, _) = right + 1, self.halves[right]
                if part != right:
                    right = part
                    continue
                limit, (_, part) = left, self.halves[left]
                if part == left:
                    return True
                left = part

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _longest(self, piece: bytes) -> list[int]:
        """For each place, the longest token that starts there."""
        found, lengths = [-1] * len(piece), self.lengths
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            found[end + 1 - lengths[token]] = token  # a later end is a longer token
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece, as merging by rank gives them."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        tokens = [token for _, token in self.automaton.iter_long(piece.decode("latin-1"))]
        pairs = self.pairs
        for pair in zip(tokens, tokens[1:]):  # noqa: B905
            known = pairs.get(pair)
            if not (self.compatible(*pair) if known is None else known):
                return self._backtrack(piece)
        return tokens

    def _backtrack(self, piece: bytes) -> list[int]:
        """As above, where the longest matches in a row do not all stand together."""
        longest, lengths, shorter, pairs = self._longest(piece), self.lengths, self.shorter, self.pairs
        closed: set[int] = set()
        tokens: list[int] = []
        place, token, size = 0, longest[0], len(piece)
        while True:
            before = tokens[-1] if tokens else -1
            while token != -1:
                end = place + lengths[token]
                if end not in closed:
                    if before < 0:
                        break
                    fits = pairs.get((before, token))
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token != -1:
                tokens.append(token)
                if end == size:
                    return tokens
                place = end
                token = longest[place]
                continue
            # Nothing fits here: close this place and shorten the token before it.
            closed.add(place)
            if not tokens:
                raise ValueError("the vocabulary lacks a byte of this text")
            token = tokens.pop()
            place -= lengths[token]

    def forget(self) -> None:
        """Start all that is remembered anew."""
        self.pieces.clear()
        if self.stretches is not None:
            self.stretches.clear()
        self.pairs.clear()
        self.held = 0

    def _remember(self, table: dict[str, list[int]], key: str, tokens: list[int]) -> None:
        if len(key) > LONGEST:
            return
        # A dictionary slot, the headers of key and list, two bytes a character, a pointer a token.
        self.held += 220 + 2 * len(key) + 8 * len(tokens)
        if self.held > MEMORY:
            self.pieces.clear()
            if self.stretches is not None:
                self.stretches.clear()
            self.held = 220 + 2 * len(key) + 8 * len(tokens)
        table[key] = tokens

    def _stretch(self, part: str) -> list[int]:
        """The tokens of a stretch of text, piece by piece."""
        out, pieces = [], self.pieces
        for piece in self.split(part):
            known = pieces.get(piece)
            if known is None:
                known = self.encode_piece(piece.encode())
                self._remember(pieces, piece, known)
            out += known
        return out

    def encode(self, text: str) -> list[int]:
        """The tokens of a whole text.

        A piece never crosses a space that is followed by a character other than
        white space, nor the start of a run of white space; so where no space has
        white space after it, the text may be cut before every space and the
        tokens of such a stretch remembered.
        """
        if self.stretches is None or _RUN.search(text):
            return self._stretch(text)
        stretches, out = self.stretches, []
        for i, word in enumerate(text.split(" ")):
            known = stretches.get(word)
            if known is None or not i:
                if i and word.isascii() and word.isalpha():  # letters after a space are one piece
                    known = self.encode_piece(f" {word}".encode())
                else:
                    known = self._stretch(f" {word}" if i else word)
                if i:
                    self._remember(stretches, word, known)
            out += known
        return out

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, tokens))


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def _forget() -> None:
    for made in _LOADED.values():
        made.forget()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ``ids`` array<int>; other columns are carried."""
    if ids in docs.columns:
        raise ValueError(f"the table has a column {ids!r}; name another one for the tokens")
    schema = docs.select("*", F.array(F.lit(0)).alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern)
        for part in textkit.pieces(batches, text):
            rows = [made.encode(x or "") for x in part.column(part.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.int32()))], names=[*part.schema.names, ids])

    return docs.mapInArrow(textkit.tidy(run, _forget), schema)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern)
        names = [str(i) for i in range(len(made.vocabulary))]
        for part in textkit.pieces(batches):
            counts, coded, decoded = [], [], []
            for value in part.column(1):
                tokens = made.encode(value.as_py() or "")
                counts.append(len(tokens))
                coded.append(hashlib.sha256(" ".join(map(names.__getitem__, tokens)).encode()).hexdigest())
                decoded.append(hashlib.sha256(made.decode(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(textkit.tidy(run, _forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
