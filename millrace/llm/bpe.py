"""BPE encoding and decoding with a merge automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens. Its states are
"the last token was p". It begins with the base symbols, each state having an arc for every symbol.
Merge k, (u, v) -> w, then installs one gadget:

* state w is made with the arcs that state v has at that time;
* every state with an arc for u gets an arc for w;
* the arc for v is struck from state u (u followed by v would have been merged).

A gadget is held as these three differences; whole rows of arcs would take states times tokens. A
sequence of tokens is the BPE encoding of its text if and only if it is a path of the finished
automaton, each text has one path, and each prefix of a path is a path. So the last token of every
prefix of a word is determined, and a word is encoded by one transition for each of its symbols: the
token automaton is spelled out into a second table whose states hold the longest suffix read that some
token begins with, and the last token at each place of that suffix. A transition finds the one token
that ends at the new place and has an arc from the last token at its start. States and transitions are
determinised when first met and kept; reading a word again is one table look-up for each symbol, with no search and
no step back. Decoding emits the labels of the arcs taken.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import KEPT, map_rows

#: Where str.split() and the tokenizer's white space differ: these four are ordinary characters for it.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed public convention)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Spelling(dict):
    """A node of the spelling trie: the next node by symbol, the token spelled so far or -1, its length, and the longest proper suffix that is a node."""

    __slots__ = ("token", "size", "shorter")

    def __init__(self, size: int, shorter: Spelling | None) -> None:
        self.token, self.size, self.shorter = -1, size, shorter


class State(dict):
    """A state of the second table: the next state by symbol, laid when first asked for; the last token and its number of symbols, the longest suffix that is a node, and the last tokens at its places."""

    __slots__ = ("token", "size", "node", "ends", "owner", "kept")

    def __init__(self, token: int, size: int, node: Spelling, ends: tuple[int, ...], owner: MergeAutomaton, kept: bool) -> None:
        self.token, self.size, self.node, self.ends, self.owner, self.kept = token, size, node, ends, owner, kept

    def __missing__(self, symbol: int) -> State:
        found = self.owner.determinise(self, symbol)
        if found.kept:
            self[symbol] = found
        return found


class MergeAutomaton:
    """The compiled merges. ``ids`` maps labels to ids; merges are pairs of labels, best first.

    At most ``keep`` states are held, those that come first, so mostly the beginnings that many words
    share; others are made again each time.
    """

    def __init__(self, ids: dict[str, int], merges: Iterable[tuple[str, str]], base: Iterable[str], keep: int = 80_000) -> None:
        self.label = {i: s for s, i in ids.items()}
        self.born: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.struck: dict[tuple[int, int], int] = {}
        self.root = Spelling(0, None)
        self.spelling: dict[int, tuple[int, ...]] = {}
        self.keep = keep
        for n, symbol in enumerate(base):
            self._spell(ids[symbol], (n,))
            self.born[ids[symbol]] = -1
        for k, (u, v) in enumerate(merges):
            self._gadget(k, ids[u], ids[v], ids[u + v])
        self._link()
        self.rest()

    def _spell(self, token: int, symbols: tuple[int, ...]) -> None:
        self.spelling[token] = symbols
        node = self.root
        for s in symbols:
            below = node.get(s)
            if below is None:
                below = node[s] = Spelling(node.size + 1, self.root)
            node = below
        node.token = token

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if w in self.born:
            raise ValueError(f"two merges make {self.label[w]!r}: states would not be determined by tokens")
        self.born[w], self.halves[w] = k, (u, v)
        self.struck[u, v] = k
        self._spell(w, self.spelling[u] + self.spelling[v])

    def _link(self) -> None:
        """Suffix links of the trie, level by level."""
        level = list(self.root.values())
        while level:
            below = []
            for node in level:
                for symbol, child in node.items():
                    at = node.shorter
                    while at is not None and symbol not in at:
                        at = at.shorter
                    child.shorter = self.root if at is None else at[symbol]
                    below.append(child)
            level = below

    def rest(self) -> None:
        """Drop the states; they are made again as words ask for them."""
        self.states: dict[tuple[int, tuple[int, ...]], State] = {}
        self.start = self._state(self.root, (-1,))

    def _state(self, node: Spelling, ends: tuple[int, ...]) -> State:
        key = (id(node), ends)
        found = self.states.get(key)
        if found is None:
            kept = len(self.states) < self.keep
            found = State(ends[-1], len(self.spelling.get(ends[-1], ())), node, ends, self, kept)
            if kept:
                self.states[key] = found
        return found

    def arc(self, p: int, t: int) -> bool:
        """Whether state p of the token automaton has an arc for token t, by unrolling the gadgets that made it."""
        if p < 0:
            return True
        before = NEVER  # only gadgets earlier than this had acted on the arc in hand
        while True:
            if self.struck.get((p, t), NEVER) < before:
                return False
            made_p, made_t = self.born[p], self.born[t]
            if made_p == made_t == -1:
                return True
            if made_p > made_t:  # state p was made later, from the arcs of its right half
                before, p = made_p, self.halves[p][1]
            else:  # arc t was laid beside the arc of its left half; of equal merges the left one goes first
                before, t = made_t + 1, self.halves[t][0]

    def determinise(self, state: State, symbol: int) -> State:
        """Where ``state`` goes by ``symbol``."""
        node, ends = state.node, state.ends
        while symbol not in node:  # every symbol is a token, so the root has it
            node = node.shorter
        node = node[symbol]
        # a token of n symbols begins n - 1 places back, and ends[-n] is the last token there
        end = node
        while end.token < 0 or not self.arc(ends[-end.size], end.token):
            end = end.shorter
        return self._state(node, (*ends[-node.size :], end.token))

    def encode(self, symbols: list[int]) -> list[int]:
        """The one path that spells ``symbols`` (indices into ``base``): a transition for each, then the tokens from the last place back."""
        state = self.start
        passed = [state := state[s] for s in symbols]
        path = []
        i = len(passed)
        while i:
            state = passed[i - 1]
            path.append(state.token)
            i -= state.size
        path.reverse()
        return path

    def decode(self, ids: Iterable[int]) -> list[str]:
        """The labels of the arcs."""
        return [self.label[i] for i in ids]


class WordCodec:
    """A word-level BPE tokenizer file (NFC, lower case, word-end suffix) run through the automaton.

    Text is cut at white space; the pieces are independent, so each distinct piece is encoded once and
    kept. At most ``keep`` pieces (and half as many words) are kept, the first that come, so mostly the
    frequent; after eight times as many misses the store starts anew. Memory is bounded for any vocabulary.
    """

    def __init__(self, spec: bytes, keep: int = 180_000) -> None:
        import regex

        spec_json = json.loads(spec)
        model = spec_json["model"]
        self.suffix = model["end_of_word_suffix"]
        self.alphabet = byte_alphabet()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        base = [*self.alphabet, *(a + self.suffix for a in self.alphabet)]  # a byte, and a byte that ends its word
        self.automaton = MergeAutomaton(model["vocab"], merges, base)
        self.special = {t["content"]: t["id"] for t in spec_json["added_tokens"]}
        labels = self.automaton.label | {i: s for s, i in self.special.items()}
        self.label = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.cut_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.pre_split = regex.compile(spec_json["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.spec, self.library = spec, None
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.special_mark = os.path.commonprefix(list(self.special))
        self.letters_are_words = self.pre_split.findall("ab") == ["ab"] and self.pre_split.findall("a" * 40) == ["a" * 40]
        self.keep = keep
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.missed = 0
        codec = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = codec._piece(piece)
                found = struct.pack(f"<{len(ids)}I", *ids)
                if len(self) < codec.keep:
                    self[piece] = found
                else:
                    codec.missed += 1
                    if codec.missed > 8 * codec.keep:
                        codec.rest()
                return found

        self.pieces = Pieces()

    def _piece(self, piece: str) -> list[int]:
        if self.special_mark not in piece or not any(s in piece for s in self.special):
            return self._plain(piece)
        ids, at = [], 0
        for m in self.cut_special.finditer(piece):
            ids += self._plain(piece[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self._plain(piece[at:])

    def _split(self, piece: str) -> list[bytes]:
        """The words of a piece, normalised, as bytes."""
        if piece.isascii():
            if self.letters_are_words and piece.isalpha():
                return [piece.lower().encode()]
            return [w.encode() for w in self.pre_split.findall(piece.lower())]
        if any(unicodedata.category(c) == "Cn" for c in piece) or newer_marks().search(piece):
            # code points that this Python does not know, but the library's tables may, and marks that only one of the two knows: the library normalises and splits
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.spec.decode())
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            return [bytes(self.byte_of[c] for c in w) for w, _ in words]
        # lower() maps a final capital sigma by its place in the word; the tokenizer maps it alone
        text = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        return [w.encode() for w in self.pre_split.findall(text)]

    def _plain(self, piece: str) -> list[int]:
        ids: list[int] = []
        for word in self._split(piece):
            known = self.words.get(word)
            if known is None:
                symbols = list(word)
                symbols[-1] += 256
                known = tuple(self.automaton.encode(symbols))
                if len(self.words) < self.keep // 2:
                    self.words[word] = known
            ids += known
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        cut = SPACES.split(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, filter(None, cut)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, joined by spaces as the tokenizer file (without a decoder) has it."""
        return " ".join(map(self.label.__getitem__, ids))

    def rest(self) -> None:
        """Drop what is kept between texts; the compiled automaton stays."""
        self.pieces.clear()
        self.words.clear()
        self.automaton.rest()
        self.missed = 0


@functools.cache
def newer_marks() -> re.Pattern[str]:
    """Combining marks that Python's tables and the library's put in another order beside others, found by comparing all of them once."""
    from tokenizers import normalizers

    library, found = normalizers.NFC(), []
    for c in map(chr, range(0x300, sys.maxunicode + 1)):
        if unicodedata.category(c)[0] == "M" and any(library.normalize_str(t) != unicodedata.normalize("NFC", t) for m in "\u0301\u0323" for t in (f"a{c}{m}", f"a{m}{c}")):
            found.append(c)
    return re.compile(f"[{''.join(map(re.escape, found))}]" if found else r"(?!)")


_CODECS: dict[str, WordCodec] = KEPT.setdefault(__name__, {})


def codec_of(spec: bytes) -> WordCodec:
    """One codec for each tokenizer file in a Python worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = WordCodec(spec)
    return _CODECS[key]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:  # a file of the driver's; its bytes go to the executors
        return f.read()


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts and decode them again; one row out for each row in, in a narrow stage.

    Returns the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if ``with_ids``,
    ``token_ids array<int>`` and ``decoded``. A null text counts as empty: no tokens, digests of the
    empty string. A null id stays null, repeated rows each give a row, an empty table gives an empty
    one. Other columns of ``df`` are not read, so their names cannot clash. The tokenizer file (of a
    fixed size) is sent to each Python worker once.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def make():
        codec = codec_of(spec.value)

        def work(text):
            n, ids_hash, text_hash, ids, decoded = [], [], [], [], []
            for t in text.to_pylist():
                raw = codec.encode_bytes(t or "")
                back = codec.decode(np.frombuffer(raw, "<u4").tolist())
                n.append(len(raw) // 4)
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids.append(raw)
                    decoded.append(back)
            out = [n, ids_hash, text_hash]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype("int32"))
                ends = np.cumsum([0, *n]).astype("int32")
                out += [pa.ListArray.from_arrays(pa.array(ends), flat), decoded]
            return out

        return lambda row_id, text: [row_id, *work(text)]

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>, decoded string" if with_ids else "")
    return map_rows(df, schema, make, [id_col, text_col])


def decode_column(ids: Column, tokenizer_path: str) -> Column:
    """Decode an ``array<int>`` column: the arcs' labels joined by spaces; null stays null."""
    spec = read_spec(tokenizer_path)

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        codec = codec_of(spec)
        return batch.map(lambda x: None if x is None else codec.decode(map(int, x)))

    return decode(ids)
