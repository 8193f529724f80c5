"""Encoding by a byte-level BPE vocabulary with a lazily determinised transducer, and streaming decoding.

The last token of the encoding of every prefix of a word decides the whole encoding: enc(prefix) = enc(prefix without
its last token) + last token. So a state of the transducer is what the next byte's last token can depend on: the
longest suffix read so far that some token begins with, and the last tokens of the prefixes that end within it. States
and transitions are made when first met and kept, up to a bound at which the table starts afresh. As no later token
begins before that suffix, the tokens before a common boundary of all positions in it are final and are emitted; the
lookahead is bounded by the longest token.

Whether two tokens may stand side by side follows from the merges: undo their merges from the latest to the earliest;
if a merge across the border would have come before the merge that is undone, they may not.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text into words before the merges of the byte-level vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START = -1


class State(dict):
    """Transitions by byte. token: the last token of any prefix that leads here."""

    __slots__ = ("suffix", "token", "window")

    def __init__(self, suffix: bytes, window: tuple[int, ...]):
        self.suffix, self.window, self.token = suffix, window, window[-1]


class Transducer:
    """Encodes words; max_states and max_words bound the memory of what is kept, not the input."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, max_words: int = 300_000):
        self.ranks, self.max_states, self.max_words = ranks, max_states, max_words
        self.bytes = {i: b for b, i in ranks.items()}
        self.heads = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(b"", (START,))
        self.states = {(b"", (START,)): self.start}
        self.pairs.clear()

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a byte. Of all ways to cut it that of which the later
        part's merge comes first is the one that the merges take; it is the one whose parts may not be cut otherwise."""
        if token not in self.split:
            b = self.bytes[token]
            ids = [self.ranks[b[i : i + 1]] for i in range(len(b))]
            while len(ids) > 2:
                best = min(range(len(ids) - 1), key=lambda i: self.joined(ids[i], ids[i + 1]))
                ids[best : best + 2] = [self.joined(ids[best], ids[best + 1])]
            self.split[token] = tuple(ids) if len(ids) == 2 else None
        return self.split[token]

    def joined(self, a: int, b: int) -> int:
        return self.ranks.get(self.bytes[a] + self.bytes[b], 1 << 30)

    def beside(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        left, right, before = a, b, 1 << 29
        while True:
            if self.joined(left, right) < before:
                ok = False
                break
            undo_left = self.parts(left) is not None and (left > right or self.parts(right) is None)
            if not undo_left and self.parts(right) is None:
                ok = True
                break
            if undo_left:
                before, left = left, self.parts(left)[1]
            else:
                before, right = right + 1, self.parts(right)[0]  # the left one of two equal merges comes first
        self.pairs[a, b] = ok
        return ok

    def step(self, at: State, byte: int) -> State:
        """Makes the transition of a state by a byte."""
        text, window = at.suffix + bytes((byte,)), at.window
        while text not in self.heads:
            text = text[1:]
        for n in range(len(text), 0, -1):
            token = self.ranks.get(text[len(text) - n :])
            if token is not None and ((before := window[len(at.suffix) + 1 - n]) == START or self.beside(before, token)):
                break
        key = (text, (*window, token)[-len(text) - 1 :])
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(*key)
        at[byte] = to
        return to

    def encode_bytes(self, data: bytes) -> list[int]:
        out: list[int] = []
        last: list[int] = []  # of each position that is not yet emitted
        at = self.start
        for byte in data:
            at = at.get(byte) or self.step(at, byte)
            last.append(at.token)
            if len(last) >= 512:
                settled = self.settled(last, len(at.suffix))
                out += self.chain(last, settled)
                del last[:settled]
        return out + self.chain(last, len(last))

    def settled(self, last: list[int], lookahead: int) -> int:
        """The latest boundary that the encodings of all prefixes within the lookahead share."""
        ends = {*range(max(0, len(last) - lookahead), len(last) + 1)}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - len(self.bytes[last[end - 1]]))
        return max(0, ends.pop())

    def chain(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= len(self.bytes[last[end - 1]])
        return out[::-1]

    def word(self, word: str) -> tuple[int, ...]:
        if len(self.states) > self.max_states:
            self.reset()
        ids = tuple(self.encode_bytes(word.encode("utf-8", "surrogatepass")))
        if len(word) <= 64:
            if len(self.words) >= self.max_words:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        out: list[int] = []
        known = self.words
        for w in SPLIT.findall(text or ""):
            out += known.get(w) or self.word(w)
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each token completes; bytes of an unfinished character wait in the decoder's state. What is
        no UTF-8 gives U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield machine.decode(self.bytes[i])
        yield machine.decode(b"", True)


SPLIT = regex.compile(WORDS)
_BUILT: dict[str, Transducer] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Broadcast:
    """A vocabulary file (under 1 MB, independent of the data), sent to the executors."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast((name, f.read()))


def transducer(sent: Broadcast) -> Transducer:
    """One a Python worker."""
    name, data = sent.value
    if name not in _BUILT:
        _BUILT[name] = Transducer(read_ranks(data))
    return _BUILT[name]


def encode_column(df: DataFrame, id_column: str, text_column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_column and ids (array<int>) of each row, repeated rows repeated; null and empty texts have no ids. Other
    columns are not read."""
    sent = vocabulary(df.sparkSession, name, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(sent)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [np.array(t.encode(x), dtype=np.int32) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(ids))], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(encode, f"`{id_column}` {kind}, ids array<int>")


def count_column(df: DataFrame, id_column: str, text_column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_column and n_tokens of each row."""
    sent = vocabulary(df.sparkSession, name, folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(sent)
        for b in batches:
            n = np.array([len(t.encode(x.as_py())) for x in b.column(1)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[id_column, "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(count, f"`{id_column}` {kind}, n_tokens bigint")


def decode_column(df: DataFrame, id_column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_column and text of each row of ids; null ids give a null text."""
    sent = vocabulary(df.sparkSession, name, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(sent)
        for b in batches:
            texts = [None if x.as_py() is None else "".join(t.decode(x.as_py())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, "ids").mapInArrow(decode, f"`{id_column}` {kind}, text string")
