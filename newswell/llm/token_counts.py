"""Token counts of byte-level BPE, by two deterministic transducers in place of the tokenizer.

The *splitter* reads classes of characters and marks where words of the tokenizer's
pattern begin. It has eleven states, so a chunk of text is a map from the state before it
to the state after it: all chunks are run from all states at once, a parallel prefix scan
composes the maps, and a second run from the states that the scan gives writes the marks.

The *counter* reads bytes of a word, and its transitions are annotated with the tokens
they add (or take back: a longer prefix may need fewer). Its states are those of the
weighted subset construction: every place from which a token may still be on its way,
with the token that ends there and the tokens since. They are compiled when a text first
needs them and kept in a bounded table, which begins anew when it is full. A word of any
length is cut into chunks that are run side by side from the state that the chunk before
them would give alone; where that was wrong, a chunk is run again when the maps compose.

Both are compiled from the tokenizer's own answers: classes of characters, and which two
tokens may follow each other, are asked of the library and remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswell.llm.shared import STEP_BYTES, Step, clean_names, map_batches, steps, to_int64

#: Tokens of a text beyond which it is ``over_limit``.
LIMIT = 1024
#: Characters of a chunk whose state map is computed; bytes of a chunk of a long word.
CHUNK, WORD_CHUNK = 256, 128
#: States of the counter that a worker keeps, and bytes of words that are counted between looks at their number.
MOST_STATES, SLICE_BYTES = 1 << 18, 1 << 16

#: Endings that the pattern takes together with an apostrophe are s, t, m, d, re, ve and ll.
SINGLE, LONGER = "stmd", {"r": "e", "v": "e", "l": "l"}
LETTER, ENDING, R, V, LL, E, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, END = range(12)
_START, _L, _N, _O, _S, _W, _Q, _QR, _QV, _QL, _C = range(11)
_UNKNOWN = 255
#: Spreads the keys of the table of transitions over its places.
_MULTIPLIER, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _split_step(state: int, kind: int) -> tuple[int, bool, bool]:
    """The state after a character, and whether a word begins at the character before it and at itself."""
    if state in (_QR, _QV, _QL):
        if kind == (LL if state == _QL else E):
            return _C, False, False
        to, _, here = _split_step(_L, kind)  # no ending: the letter after the apostrophe begins a word
        return to, True, here
    if state == _Q:
        if kind == ENDING:
            return _C, False, False
        if kind in (R, V, LL):
            return {R: _QR, V: _QV, LL: _QL}[kind], False, False
        state = _O
    if kind == END:
        return _START, False, True
    if kind in (SPACE, WHITE):
        return (_S if kind == SPACE else _W), False, state not in (_S, _W)
    to = _L if kind <= E else _N if kind == NUMBER else _O
    if kind == APOSTROPHE and state not in (_O, _S):
        to = _Q
    if state == _S:  # the blank before a word is its own first character
        return to, True, False
    if state == _W:  # other white space before a word is a word by itself
        return to, True, True
    return to, False, to == _Q or to != state


class Splitter:
    """Marks the characters at which words begin."""

    def __init__(self):
        cells = [_split_step(s, k) for s in range(11) for k in range(12)]
        self.next = np.array([to for to, _, _ in cells], np.uint8)
        self.out = np.array([2 * before + here for _, before, here in cells], np.uint8)

    def starts(self, kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        n = len(kinds)
        rows = np.full(-(-max(n, 1) // chunk) * chunk, END, np.uint8)
        rows[:n] = kinds
        rows = np.ascontiguousarray(rows.reshape(-1, chunk).T)
        maps = np.repeat(np.arange(11, dtype=np.uint8)[:, None], rows.shape[1], axis=1)
        for row in rows:
            maps = self.next[maps * np.uint8(12) + row]
        far = 1
        while far < maps.shape[1]:  # after each turn a map spans twice as many chunks
            maps = np.concatenate([maps[:, :far], np.take_along_axis(maps[:, far:], maps[:, :-far].astype(np.intp), axis=0)], axis=1)
            far *= 2
        state = np.concatenate([[_START], maps[_START, :-1]]).astype(np.uint8)
        marks = np.empty_like(rows)
        for k, row in enumerate(rows):
            at = state * np.uint8(12) + row
            marks[k], state = self.out[at], self.next[at]
        marks = marks.T.ravel()[:n]
        found = (marks & 1).astype(bool)
        found[:-1] |= marks[1:] > 1
        return found


class Counter:
    """Tokens of words, by transitions that are compiled when first needed."""

    def __init__(self, model, vocabulary: dict[str, int], alphabet: dict[str, int]):
        self.model, self.follows = model, {}
        self.text, self.edges, self.token, children = {}, {}, [-1], [False]
        for string, number in vocabulary.items():
            node = 0
            for c in string:
                byte = alphabet.get(c)
                if byte is None:  # not made of bytes: no text is encoded so
                    break
                to = self.edges.get(node << 8 | byte)
                if to is None:
                    to = self.edges[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    children.append(False)
                    children[node] = True
                node = to
            else:
                self.token[node] = number
                self.text[number] = string
        self.open = children
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.keys = np.full(8 * MOST_STATES, -1, np.int64)
        self.to = np.zeros(8 * MOST_STATES, np.int32)
        self.gain = np.zeros(8 * MOST_STATES, np.int16)
        self.filled = 0
        self.known((0, -1, 0))

    def known(self, state: tuple) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number

    def room(self, more: int) -> None:
        """Begin anew unless so many more states and transitions can be kept."""
        if len(self.states) + more > MOST_STATES or self.filled + more > 4 * MOST_STATES:
            self.reset()

    def may_follow(self, one: int, other: int) -> bool:
        """Whether the library leaves two tokens as they are where they meet; -1 stands for the beginning."""
        key = one << 20 | other
        found = self.follows.get(key)
        if found is None:
            ids = [t.id for t in self.model.tokenize((self.text[one] if one >= 0 else "") + self.text[other])]
            if len(self.follows) > MOST_STATES:
                self.follows.clear()
            found = self.follows[key] = ids == ([one, other] if one >= 0 else [other])
        return found

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after a byte and the tokens that it adds. A state lists node, token before and tokens since of each place."""
        alive, end = [], None
        for k in range(0, len(state), 3):
            node = self.edges.get(state[k] << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if end is None and token >= 0 and self.may_follow(state[k + 1], token):
                end, gain = token, state[k + 2] + 1
            if self.open[node]:
                alive.append((node, state[k + 1], state[k + 2]))
        if end is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        return tuple(x for node, last, since in alive for x in (node, last, since - gain)) + (0, end, 0), gain

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, or the free place at which it would."""
        mask = len(self.keys) - 1
        at = ((keys.view(np.uint64) * np.uint64(_MULTIPLIER)) >> np.uint64(40)).astype(np.int64) & mask
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = self.keys[at[todo]]
            todo = todo[(found != keys[todo]) & (found != -1)]
        return at

    def move(self, states: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states << 8 | bytes_
        at = self._slots(keys)
        missing = np.flatnonzero(self.keys[at] == -1)
        if len(missing):
            new = np.unique(keys[missing])
            for key in new.tolist():
                state, gain = self.step(self.states[key >> 8], key & 255)
                place = (key * _MULTIPLIER & _WORD) >> 40 & len(self.keys) - 1
                while self.keys[place] != -1:
                    place = place + 1 & len(self.keys) - 1
                self.keys[place], self.to[place], self.gain[place] = key, self.known(state), gain
            self.filled += len(new)
            at[missing] = self._slots(keys[missing])
        return self.to[at].astype(np.int64), self.gain[at]

    def run(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and tokens after each run of bytes, all read side by side from the states given."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, states = starts[order], sizes[order], states[order]
        tokens = np.zeros(len(sizes), np.int64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k, "left"))
            states[:n], gain = self.move(states[:n], data[starts[:n] + k].astype(np.int64))
            tokens[:n] += gain
        back = np.argsort(order)
        return states[back], tokens[back]

    def words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        out = np.zeros(len(sizes), np.int64)
        short = np.flatnonzero(sizes <= 2 * WORD_CHUNK)
        total = np.cumsum(sizes[short])
        k = 0
        while k < len(short):
            to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + SLICE_BYTES, "right")))
            self.room(SLICE_BYTES)
            own = short[k:to]
            out[own] = self.run(data, starts[own], sizes[own], np.zeros(len(own), np.int64))[1]
            k = to
        for k in np.flatnonzero(sizes > 2 * WORD_CHUNK):
            out[k] = self.long_word(data[starts[k] : starts[k] + sizes[k]])
        return out

    def long_word(self, data: np.ndarray) -> int:
        """Chunks run side by side from the state that the chunk before them gives by itself, then composed in order."""
        state, total = self.states[0], 0
        for low in range(0, len(data), SLICE_BYTES):
            self.room(3 * SLICE_BYTES + 2 * WORD_CHUNK)
            part = data[low : low + SLICE_BYTES]
            starts = np.arange(0, len(part), WORD_CHUNK)
            sizes = np.minimum(WORD_CHUNK, len(part) - starts)
            guess = np.concatenate([[self.known(state)], self.run(part, starts[:-1], sizes[:-1], np.zeros(len(starts) - 1, np.int64))[0]])
            after, tokens = self.run(part, starts, sizes, guess.copy())
            at, maps = int(guess[0]), {}
            for k in range(len(starts)):
                if at == guess[k]:
                    at, n = int(after[k]), int(tokens[k])
                else:
                    key = (at, part[starts[k] : starts[k] + sizes[k]].tobytes())
                    if key not in maps:
                        to, more = self.run(part, starts[k : k + 1], sizes[k : k + 1], np.array([at]))
                        maps[key] = int(to[0]), int(more[0])
                    at, n = maps[key]
                total += n
            state = self.states[at]
        return total


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabularies of byte-level tokenizers: itself where it shows, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class TokenCounter:
    """Counts what a byte-level BPE tokenizer file of the ``tokenizers`` library gives, special strings found in texts included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, split = made["model"], made["pre_tokenizer"] or {}
        added = [t for t in made["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout") if model.get(k)] + [k for k in ("fuse_unk", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or made["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or added or odd:
            raise ValueError("only byte-level BPE without normalisation and with plain special tokens is compiled")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted((t["content"].encode() for t in made["added_tokens"]), key=len, reverse=True)
        self.splitter = Splitter()
        self.counter = Counter(self.tokenizer.model, {k: v for k, v in model["vocab"].items()}, byte_alphabet())
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        for c, kind in [(c, ENDING) for c in SINGLE] + [("r", R), ("v", V), ("l", LL), ("e", E), ("'", APOSTROPHE), (" ", SPACE)]:
            self.kinds[ord(c)] = kind

    def _kind(self, c: str) -> int:
        one = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1
        return LETTER if one("a" + c) else NUMBER if one("1" + c) else OTHER if one("!" + c) else WHITE

    def _special(self, step: Step) -> list[tuple[int, int]]:
        """Where special strings stand: the leftmost first, the longest of those that begin together."""
        data, found = step.data.tobytes(), []
        for text in self.special:
            at = data.find(text)
            while at >= 0:
                found.append((at, at + len(text)))
                at = data.find(text, at + 1)
        out, end = [], 0
        for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
            if a >= end and step.offsets[np.searchsorted(step.offsets, a, "right")] >= b:
                out.append((a, b))
                end = b
        return out

    def words(self, step: Step, special: list[tuple[int, int]] = ()) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Where the words of the pattern begin, the different words, and the number of each in them. Texts and special strings end words."""
        data = np.ascontiguousarray(step.data)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        if (kinds == _UNKNOWN).any():
            for c in np.unique(points[kinds == _UNKNOWN]).tolist():
                self.kinds[c] = self._kind(chr(c))
            kinds = self.kinds[points]
        ends = np.sort(np.concatenate([step.offsets[1:], np.array(special, np.int64).ravel()]))
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(chars, ends)
        marks = self.splitter.starts(np.insert(kinds, at, END))
        starts = np.insert(chars, at, ends)[marks]
        starts = starts[np.diff(starts, append=len(data)) > 0]
        return starts, *distinct(data, starts)

    def _count(self, step: Step) -> np.ndarray:
        special = self._special(step)
        starts, words, indices = self.words(step, special)
        _, where, text = words.buffers()
        where = np.frombuffer(where, np.int64)[: len(words) + 1]
        n = self.counter.words(np.frombuffer(text or b"", np.uint8), where[:-1], np.diff(where))[indices]
        for a, b in special:
            low, high = np.searchsorted(starts, (a, b))
            n[low:high] = 0
            n[low] = 1
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.searchsorted(starts, step.offsets)
        return total[at[1:]] - total[at[:-1]]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a column; nulls are empty."""
        out = np.zeros(len(texts), np.int64)
        for row, step in steps(texts):
            for part in parts(step):
                n = self._count(part)
                out[row : row + len(n)] += n
        return out


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different ones of the ranges that begin at ``starts``, each up to the next, and the number of each range in them."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return words.dictionary, np.asarray(words.indices)


def parts(step: Step, limit: int = STEP_BYTES) -> Iterator[Step]:
    """A step as it is, or a very long text in parts: before a blank after an ASCII letter or digit a word begins whatever stood before."""
    data = step.data
    if step.docs > 1 or len(data) <= 2 * limit:
        yield step
        return
    low = 0
    while low < len(data):
        high = low + limit
        while high < len(data):
            seen = data[high - 1 : high + limit]
            solid = ((seen >= 48) & (seen <= 57)) | ((seen | 32) >= 97) & ((seen | 32) <= 122)
            cut = np.flatnonzero(solid[:-1] & (seen[1:] == 32))
            if len(cut):
                high += int(cut[0])
                break
            high += limit
        high = min(high, len(data))
        yield Step(data[low:high], np.array([0, high - low]))
        low = high


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``.

    Null texts are empty: no bytes, no tokens. Repeated rows and repeated or null ids (of any type) are
    rows like others; columns besides ``doc_id`` and ``text`` are not looked at. Texts of any length are read whole, in
    parts of about a megabyte. An empty table gives an empty result. Tokenizer files of other kinds are refused with
    a ``ValueError``. Rows stay where they are: there is no shuffle.
    """
    counter(tokenizer)
    docs = clean_names(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from newswell.llm.token_counts import counter as mine

        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), to_int64(mine(tokenizer).count(batch.column(1)))], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return map_batches(sized, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
