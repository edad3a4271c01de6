"""BPE over streams: a transducer that emits a token as soon as nothing to come can change it.

From the merge list follows how far to the right a token can depend on the text: a token gives way only
to a merge of it, or of the parts that end where it ends, with what follows, and that in turn may fall to
an earlier merge further right. Ranks fall along such a chain, so its longest length is a dynamic program
over the merges by rank. A run of symbols is cut into buffers of that many symbols and a piece more; the
tokens that end before the last ``lookahead`` symbols are final, and encoding goes on behind them.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from cloakframe.llm.common import map_rows
from cloakframe.llm.pretokens import byte_symbols, split_words

#: Characters read at a time, and symbols of a run that are encoded at a time.
CHUNK = 1 << 16
PIECE = 1 << 12


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols behind a token that can decide whether it stays.

    ``reach[i]`` is how far merge ``i`` looks right of its left part: the length of the right part, and
    what that part itself depends on. A token depends on merges whose left part ends where it ends: the
    token, its right half, that one's right half and so on, each as long as it is not merged away, so by
    earlier merges than the one that made the next larger part.
    """
    rank, halves = {}, {}
    for i, (a, b) in enumerate(merges):
        rank.setdefault(a + b, i)
        halves.setdefault(a + b, (a, b))
    # For each left part: the ranks of its merges and the furthest reach up to each.
    ranks: dict[str, list[int]] = {}
    furthest: dict[str, list[int]] = {}

    def depends(token: str, before: int) -> int:
        most, limit = 0, before
        while True:
            at = bisect_left(ranks.get(token, ()), limit)
            if at:
                most = max(most, furthest[token][at - 1])
            if token not in halves:
                return most
            limit, token = min(limit, rank[token]), halves[token][1]

    for i, (a, b) in enumerate(merges):
        reach = len(b) + depends(b, i)
        known = furthest.setdefault(a, [])
        known.append(max(reach, known[-1] if known else 0))
        ranks.setdefault(a, []).append(i)
    tokens = {t for pair in merges for t in pair} | set(rank)
    return max((depends(t, len(merges)) for t in tokens), default=0)


@dataclass
class StreamCoder:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library whose words have an end mark."""

    path: str
    chunk: int = CHUNK
    piece: int = PIECE
    memory: int = 1 << 18

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _file(self) -> dict:
        with open(self.path, encoding="utf-8") as file:
            return json.load(file)

    @cached_property
    def settings(self) -> dict:
        """The file without vocabulary and merges, which the library holds."""
        file = self._file()
        return file | {"model": {k: v for k, v in file["model"].items() if k not in ("vocab", "merges")}}

    @cached_property
    def lookahead(self) -> int:
        merges = self._file()["model"]["merges"]
        return sufficient_lookahead([tuple(m.split(" ") if isinstance(m, str) else m) for m in merges])

    @cached_property
    def symbols(self) -> dict[int, str]:
        return byte_symbols()

    @cached_property
    def names(self) -> dict[int, str]:
        return {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}

    @cached_property
    def spelled(self) -> dict[int, bytes]:
        return {i: t.encode("utf-8", "replace") for t, i in self.library.get_vocab(with_added_tokens=True).items()}

    @cached_property
    def specials(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self.settings["added_tokens"]}

    @cached_property
    def special_pattern(self) -> regex.Pattern:
        longest = sorted(self.specials, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, longest)) + ")" if longest else "(?!)()")

    @cached_property
    def split_pattern(self) -> regex.Pattern:
        return regex.compile(self.settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    # -- encoding --------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of normalised text."""
        return split_words(self.split_pattern, text)

    def _tokens(self, symbols: str) -> list[tuple[int, str]]:
        return [(t.id, t.value) for t in self.library.model.tokenize(symbols)]

    def run(self, parts: Iterable[str]) -> Iterator[tuple[int, str]]:
        """Tokens of one word that arrives in parts, in constant memory.

        The library marks the last symbol of what it is given as the end of a word, so that symbol of an
        unfinished buffer counts as unknown, like those behind it.
        """
        held = ""
        for part in parts:
            held += "".join(map(self.symbols.__getitem__, part.encode("utf-8")))
            while len(held) > self.piece + self.lookahead + 1:
                buffer = held[: self.piece + self.lookahead + 1]
                done = 0
                for number, name in self._tokens(buffer):
                    if done + len(name) > self.piece:
                        break
                    done += len(name)
                    yield number, name
                if not done:  # no token is longer than a piece
                    raise ValueError(f"a token is longer than {self.piece} symbols")
                held = held[done:]
        if held:
            yield from self._tokens(held)

    def _chunks(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text that normalise on their own, and whether a word may go on behind them.

        Cuts lie at white space, or in a run without any before an ASCII character, which combines with nothing
        before it. A run with neither is one part.
        """
        at = 0
        while len(text) - at > self.chunk:
            cut = regex.compile(r"\s\S*+\Z").search(text, at, at + self.chunk)
            end, open_ = (cut.start(), False) if cut and cut.start() > at else (at + self.chunk, True)
            if open_:
                found = regex.compile(r"[\x00-\x7F]").search(text, end)
                end = found.start() if found else len(text)
            yield text[at:end], open_ and end < len(text)
            at = end
        yield text[at:], False

    def pieces(self, text: str) -> Iterator[list[str] | str]:
        """Lists of whole words, and special tokens on their own, in the order of the text."""
        for i, part in enumerate(self.special_pattern.split(text) if self.specials else [text]):
            if i % 2:
                yield part
                continue
            held = ""
            for chunk, more in self._chunks(part):
                known = held + self.library.normalizer.normalize_str(chunk)
                words = self.words(known)
                # The last words of an open part may go on, or become one with what follows, unless white space
                # lies behind them.
                kept = min(2, len(words)) if more else 0
                while not known.endswith(held := "".join(words[len(words) - kept :])):
                    kept -= 1
                yield words[: len(words) - kept]

    def encode(self, text: str) -> Iterator[tuple[int, str]]:
        """Ids and names of the tokens of a text."""
        for piece in self.pieces(text):
            if isinstance(piece, str):
                yield self.specials[piece], piece
            else:
                for word in piece:
                    yield from self.run(word[i : i + self.piece] for i in range(0, len(word), self.piece))

    # -- decoding --------------------------------------------------------------------------------

    def joined(self, ids: bytes) -> bytes:
        """What little-endian ids decode to for a file without decoder: their names, joined by blanks as by the library."""
        return b" ".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the tokens as it becomes known: bytes go through an incremental UTF-8 decoder, the end
        of a word gives a blank, and broken bytes become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        values = {s: b for b, s in self.symbols.items()}
        end = self.settings["model"].get("end_of_word_suffix") or ""
        marks = {i: t for t, i in self.specials.items()}
        for number in ids:
            if number in marks:
                yield state.decode(b"", True) + marks[number]
                state.reset()
                continue
            name = self.names[number]
            closed = bool(end) and name.endswith(end)
            yield state.decode(bytes(values[s] for s in (name[: -len(end)] if closed else name)))
            if closed:
                yield state.decode(b"", True) + " "
                state.reset()
        yield state.decode(b"", True)


class _Ids(dict):
    """Ids of whole words met so far, as bytes; forgotten when they are too many."""

    def __init__(self, coder: StreamCoder):
        self.coder = coder

    def __missing__(self, word: str) -> bytes:
        value = b"".join(i.to_bytes(4, "little") for i, _ in self.coder.run([word]))
        if len(word) <= 64:
            if len(self) > self.coder.memory:
                self.clear()
            self[word] = value
        return value


class _Words:
    """Ids and names of whole words, as bytes. A word is remembered with its ids alone, which name its names."""

    def __init__(self, coder: StreamCoder):
        self.coder, self.ids = coder, _Ids(coder)

    def __getitem__(self, word: str) -> tuple[bytes, bytes]:
        return self.of([word])

    def of(self, words: Iterable[str]) -> tuple[bytes, bytes]:
        """Of words in a row."""
        ids = b"".join(map(self.ids.__getitem__, words))
        return ids, self.coder.joined(ids)


_CODERS: dict[str, tuple[StreamCoder, _Words]] = {}


def _coder(path: str) -> tuple[StreamCoder, _Words]:
    """One coder for each worker process and file."""
    if path not in _CODERS:
        coder = StreamCoder(path)
        _CODERS[path] = coder, _Words(coder)
    return _CODERS[path]


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each whole text.

    Ids are hashed as little-endian unsigned 32-bit integers, and decoded from: a file without decoder decodes to
    the names of its ids joined by blanks, as the library does. Null texts count as empty: no tokens, an empty text.
    Rows are independent: repeats give repeats, null keys stay, and an empty table gives no rows.
    """

    def rows(part: Iterable[tuple]) -> Iterator[tuple]:
        coder, known = _coder(path)
        if coder.settings["decoder"]:
            raise ValueError("files with a decoder of their own are not meant here")
        for name, content in part:
            n, ids, decoded, first = 0, hashlib.sha256(), hashlib.sha256(), True
            for piece in coder.pieces(content or ""):
                if isinstance(piece, str):
                    numbers = coder.specials[piece].to_bytes(4, "little")
                    found = numbers, coder.joined(numbers)
                else:
                    found = known.of(piece)
                if found[0]:
                    n += len(found[0]) // 4
                    ids.update(found[0])
                    decoded.update((b"" if first else b" ") + found[1])
                    first = False
            yield name, n, ids.hexdigest(), decoded.hexdigest()

    kind = docs.schema[key].dataType.simpleString()
    out = map_rows(docs.select(key, text), rows, f"name {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("name", key)
