"""BPE encoding and decoding with an automaton that only accepts right tokenizations.

The automaton reads tokens. It begins as one state that every symbol leads back to, and each merge of u and v
into t puts in one gadget: all arcs labelled u are led to a copy of the state they entered, the copy
loses its arc for v, and every state that has an arc for u gets one for t, into the state that v enters (for u = v into
the state that was copied). After the last merge, the label sequences from the first state are just the
results of merging. As arcs of one label enter one state, a state says which tokens may not follow.

Written out the arcs would be states times tokens, billions. So they are kept as differences: a state knows the label it
was copied for and until when it shared that label's losses, and a label knows the arcs that its gadgets took away and
what its first copy was made of. The rest is read through the original, at the time of copying, and an arc of a
merged token through the arc of its left part: a few look-ups, each as deep as the tokens' parts.

A word is encoded from the left: each prefix of it has just one right tokenization, so there is one state a
place, and the arcs whose labels continue the word lead on to later places. The labels on the way back from the
end are the tokens. Many words take each step together, as look-ups in tables. The work is the word's length
times the longest token's. Decoding emits the labels.

Normalising and splitting into words are done by the library that the file is for, once for each distinct run between
white space, which neither step sees across. Strings of added tokens in a text give their own ids, as in that
library. The tokens of the runs met last are remembered, up to a bound.

Null text counts as empty, empty text gives no ids and decodes to the empty string, repeated rows are each encoded, an
empty table gives no rows. A very long text or word takes time in proportion; nothing is cut. Other columns pass through;
``ids`` and ``decoded`` replace columns of those names.
"""

from __future__ import annotations

import functools
import json
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pacelake.llm.common import Recent, slices

KNOWN = 120_000
"""Runs whose tokens a worker remembers of the newer generation; the older one has as many."""

LONG_RUN = 64
"""Longer runs are not remembered."""

FEW = 100
"""Fewer steps are taken one by one, as towards the end of a very long word."""

BATCH_CHARS = 120_000
"""Text of distinct words that is encoded at once."""

SLICE_CHARS = 500_000
SLICE_TOKENS = 200_000
LAST, NEVER = 1 << 60, 1 << 61
BLANKS = regex.compile(r"[\t-\r ]+")
ODD_BLANKS = re.compile("[\x1c-\x1f]")
"""White space for str.split, though not for the tokenizer. All other that it knows, the tokenizer knows as well."""


class Automaton:
    """``symbols`` are numbered tokens, ``merges`` rows (left, right, result) in order."""

    FILTER = 1 << 20

    def __init__(self, symbols: list[int], merges: list[tuple[int, int, int]]):
        enters, made = dict.fromkeys(symbols, 0), dict.fromkeys(symbols, -1)
        self.made, self.left = made, {}
        # A state belongs to the label it was copied for, and shows that label's losses up to a time.
        self.label, self.until = [-1], [LAST]
        # For a label with copies: the label that the first one's original belongs to, and up to when it counts.
        self.root, self.cut = {}, {}
        self.taken: dict[tuple[int, int], int] = {}
        entering = Counter({0: len(symbols) + 1})  # the start counts as one more
        for time, (left, right, result) in enumerate(merges):
            if left not in made or right not in made or result in made:
                raise ValueError(f"merge {time} is not of earlier tokens into a new one")
            made[result], self.left[result] = time, left
            state = enters[left]
            if state < 0 or enters[right] < 0 or not self._arc(state, right, time - 1):
                enters[result] = -1  # an earlier merge always comes between
                continue
            if self.label[state] != left:
                self.root[left], self.cut[left] = self.label[state], min(self.until[state], time - 1)
            if self.label[state] != left or entering[state] > 1 or left == right:
                if self.label[state] == left:
                    self.until[state] = time - 1
                enters[left] = len(self.label)
                self.label.append(left)
                self.until.append(LAST)
                entering[state] -= 1
                entering[enters[left]] = 1
            self.taken[left, right] = time
            enters[result] = state if left == right else enters[right]
            entering[enters[result]] += 1
        self._tabulate(enters)

    def _arc(self, state: int, token: int, time: int) -> bool:
        """Whether the state had an arc for the token after the merge of that time."""
        while True:
            label, until = self.label[state], min(time, self.until[state])
            while label >= 0:
                if self.taken.get((label, token), NEVER) <= until:
                    return False
                label, until = self.root.get(label, -1), min(until, self.cut.get(label, -1))
            if self.made[token] < 0:
                return True
            token, time = self.left[token], self.made[token]

    def _tabulate(self, enters: dict[int, int]) -> None:
        self.entered, self.size = enters, max(enters) + 1
        self.enters, self.made_at, self.left_of, self.roots, self.cuts = (
            np.full(self.size, -1, dtype=np.int64) for _ in range(5)
        )
        for table, rows in (
            (self.enters, enters), (self.made_at, self.made), (self.left_of, self.left), (self.roots, self.root), (self.cuts, self.cut)
        ):
            table[list(rows)] = list(rows.values())
        self.labels, self.untils = np.array(self.label), np.array(self.until)
        keys = np.array([label * self.size + token for label, token in self.taken], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.times = keys[order], np.array(list(self.taken.values()), dtype=np.int64)[order]
        self.maybe = np.zeros(self.FILTER, dtype=bool)
        self.maybe[self._slot(keys)] = True
        self.table_keys, self.table_to = np.full(self.FILTER, -1, dtype=np.int64), np.zeros(self.FILTER, dtype=np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 12) & (self.FILTER - 1)

    def _gone(self, states: np.ndarray, tokens: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whether a gadget took the arc away by then, from the state or from what it is a copy of."""
        gone = np.zeros(len(states), dtype=bool)
        rows, labels, times = np.arange(len(states)), self.labels[states], np.minimum(times, self.untils[states])
        while True:
            on = labels >= 0
            if not on.all():
                rows, labels, tokens, times = rows[on], labels[on], tokens[on], times[on]
            if not len(rows):
                return gone
            keys = labels * self.size + tokens
            some = np.flatnonzero(self.maybe[self._slot(keys)])
            place = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            gone[rows[some[(self.keys[place] == keys[some]) & (self.times[place] <= times[some])]]] = True
            times, labels = np.minimum(times, self.cuts[labels]), self.roots[labels]

    def step(self, state: int, token: int) -> int:
        to = self.entered.get(token, -1)
        return to if to >= 0 and self._arc(state, token, LAST) else -1

    def steps(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The state that each token leads to from its state, or -1.

        Steps taken lately are in a table, each under a place that its hash gives, one a place.
        """
        keys = states * self.size + tokens
        place = self._slot(keys)
        to = self.table_to[place]
        new = np.flatnonzero(self.table_keys[place] != keys)
        if len(new):
            to[new] = self._looked_up(states[new], tokens[new])
            self.table_keys[place[new]], self.table_to[place[new]] = keys[new], to[new]
        return to

    def _looked_up(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        to = self.enters[tokens]
        rows = np.flatnonzero(to >= 0)
        states, tokens = states[rows], tokens[rows]
        times = np.full(len(rows), LAST)
        while len(rows):
            gone = self._gone(states, tokens, times)
            to[rows[gone]] = -1
            on = ~gone & (self.made_at[tokens] >= 0)
            rows, states, tokens = rows[on], states[on], tokens[on]
            times, tokens = self.made_at[tokens], self.left_of[tokens]
        return to


class Labels:
    """The tokens' strings as a tree, to find the tokens that continue a word; ``end`` closes the last one of a word."""

    def __init__(self, ids: dict[str, int], end: str):
        self.letters = {letter: i for i, letter in enumerate(sorted({c for label in ids for c in label}))}
        if len(self.letters) > 256:
            raise ValueError("more than 256 symbols")
        self.codes = {ord(letter): chr(i) for letter, i in self.letters.items()}
        children, inner, last = [{}], [-1], [-1]
        for label, token in ids.items():
            closes = bool(end) and label.endswith(end)
            node = 0
            for letter in label[: len(label) - len(end)] if closes else label:
                code = self.letters[letter]
                if code not in children[node]:
                    children[node][code] = len(children)
                    children.append({})
                    inner.append(-1)
                    last.append(-1)
                node = children[node][code]
            if not closes:
                inner[node] = token
            if closes or not end:
                last[node] = token
        # Row 0 stands for all nodes without children.
        inside = [node for node, to in enumerate(children) if to]
        self.rows = np.zeros(len(children), dtype=np.int32)
        self.rows[inside] = np.arange(1, len(inside) + 1)
        self.children = np.zeros((len(inside) + 1, len(self.letters)), dtype=np.int32)
        for node in inside:
            self.children[self.rows[node], list(children[node])] = list(children[node].values())
        self.inner, self.last = np.array(inner, dtype=np.int32), np.array(last, dtype=np.int32)

    def coded(self, words: list[str]) -> np.ndarray:
        """The words' symbols, one after another."""
        out = "".join(words).translate(self.codes)
        try:
            return np.frombuffer(out.encode("latin-1"), dtype=np.uint8)
        except UnicodeEncodeError:
            raise ValueError("a word has symbols that the vocabulary lacks") from None

    def continuing(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, token) of all tokens in the words; ``ends`` is where each symbol's word ends."""
        begins, nodes = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), dtype=np.int32)
        found, width = [], 0
        while len(begins):
            nodes = self.children[self.rows[nodes], codes[begins + width]]
            width += 1
            on = nodes > 0
            begins, nodes = begins[on], nodes[on]
            closing = begins + width == ends[begins]
            tokens = np.where(closing, self.last[nodes], self.inner[nodes])
            hit = tokens >= 0
            found.append((begins[hit], begins[hit] + width, tokens[hit]))
            begins, nodes = begins[~closing], nodes[~closing]
        return tuple(np.concatenate(parts) if parts else np.empty(0, np.int32) for parts in zip(*found, strict=True))


class Coder:
    """One worker's automaton, vocabulary and library for splitting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        model = read["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE model")
        if read["decoder"] is not None:
            raise ValueError("decoding is joining labels by blanks; this file names another decoder")
        if any(token[flag] for token in read["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with conditions")
        self.path = path
        self.labels = {i: label for label, i in model["vocab"].items()} | {x["id"]: x["content"] for x in read["added_tokens"]}
        self.added = {x["content"]: np.int32(x["id"]).astype("<i4").tobytes() for x in read["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.known = Recent(KNOWN)

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def compiled(self) -> tuple[Automaton, Labels]:
        """Built by the first task that encodes; decoding needs the labels alone."""
        with open(self.path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids: dict[str, int] = model["vocab"]
        merges = [tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in model["merges"]]
        rows = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        results = {row[2] for row in rows}
        automaton = Automaton([i for i in ids.values() if i not in results], rows)
        return automaton, Labels(ids, model.get("end_of_word_suffix") or "")

    @functools.cached_property
    def letters_stay(self) -> bool:
        """Whether ASCII is only lower-cased and its letters never split, tried on all of it and on all pairs of letters."""
        pairs = [a + b for a in string.ascii_letters for b in string.ascii_letters]
        split = [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(" ".join(pairs))]
        shown = "".join(map(chr, range(0x21, 0x7F)))
        return split == pairs and self.library.normalizer.normalize_str(shown) == shown.lower()

    def normal(self, runs: list[str]) -> list[str]:
        """The runs normalised; together where no white space is in them, as then each keeps its place."""
        together = self.library.normalizer.normalize_str(" ".join(runs)).split(" ")
        if len(together) == len(runs) and all(together):
            return together
        return [self.library.normalizer.normalize_str(run) for run in runs]

    def words(self, words: list[str]) -> list[bytes]:
        """The tokens of pre-split words, packed."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        automaton, tree = self.compiled
        codes = tree.coded(words)
        begin, end, token = tree.continuing(codes, np.repeat(ends, lengths))
        # Places are symbols, and one more a word for its end.
        word = np.repeat(np.arange(len(words)), lengths)[begin]
        begin, end = begin + word, end + word
        depth = begin - (ends - lengths + np.arange(len(words)))[word]
        order = np.argsort(depth, kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        states = np.full(len(codes) + len(words), -1, dtype=np.int64)
        back, by = np.zeros(len(states), dtype=np.int64), np.zeros(len(states), dtype=np.int32)
        states[ends - lengths + np.arange(len(words))] = 0
        cuts = np.concatenate(([0], np.cumsum(np.bincount(depth, minlength=1))))
        many = np.flatnonzero(np.diff(cuts) >= FEW)
        many = many[-1] + 1 if len(many) else 0
        for a, b in zip(cuts[:many].tolist(), cuts[1 : many + 1].tolist(), strict=True):
            at = states[begin[a:b]]
            rows = np.flatnonzero(at >= 0)
            to = automaton.steps(at[rows], token[a:b][rows])
            rows, to = rows[to >= 0] + a, to[to >= 0]
            states[end[rows]], back[end[rows]], by[end[rows]] = to, begin[rows], token[rows]
        for a, b, label in zip(*(x[cuts[many] :].tolist() for x in (begin, end, token)), strict=True):
            at = states.item(a)
            to = automaton.step(at, label) if at >= 0 else -1
            if to >= 0:
                states[b], back[b], by[b] = to, a, label
        place = ends + np.arange(len(words))
        if (states[place] < 0).any():
            raise ValueError("a word has no tokenization")
        # All words go back from their ends together.
        first = ends - lengths + np.arange(len(words))
        passed = np.zeros(len(states), dtype=bool)
        while len(place):
            on = place > first
            place, first = place[on], first[on]
            passed[place] = True
            place = back[place]
        tokens = by[passed].astype("<i4")
        counts = np.add.reduceat(passed, ends - lengths + np.arange(len(words)), dtype=np.int64) if words else []
        stops, packed = (4 * np.cumsum([0, *counts])).tolist(), tokens.tobytes()
        return [packed[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def runs(self, runs: list[str]) -> dict[str, bytes]:
        """The tokens of runs between white space."""
        out = {}
        for a, b in slices(map(len, runs), BATCH_CHARS):
            plain = [run for run in runs[a:b] if run.isascii() and run.isalpha()] if self.letters_stay else []
            other = [run for run in runs[a:b] if not (run.isascii() and run.isalpha())] if self.letters_stay else runs[a:b]
            lower = " ".join(plain).lower().split(" ") if plain else []
            other.sort(key=str.isascii)  # False first
            ascii_from = next((i for i, run in enumerate(other) if run.isascii()), len(other)) if self.letters_stay else len(other)
            normal = self.normal(other[:ascii_from]) if ascii_from else []
            normal += " ".join(other[ascii_from:]).lower().split(" ") if ascii_from < len(other) else []
            starts = np.cumsum([0, *(len(x) + 1 for x in normal)])
            split = self.library.pre_tokenizer.pre_tokenize_str(" ".join(normal))
            of = np.searchsorted(starts, [begin for _, (begin, _) in split], side="right") - 1
            distinct = list(dict.fromkeys([*lower, *(word for word, _ in split)]))
            packed = dict(zip(distinct, self.words(distinct), strict=True))
            out |= zip(plain, map(packed.__getitem__, lower), strict=True)
            joined = [[] for _ in other]
            for (word, _), i in zip(split, of.tolist(), strict=True):
                joined[i].append(packed[word])
            out |= zip(other, map(b"".join, joined), strict=True)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        read = []
        for text in texts:
            runs = []
            for part in self.at_added.split(text) if self.at_added else [text]:
                if part in self.added:
                    runs.append(part)
                else:
                    runs += BLANKS.split(part) if ODD_BLANKS.search(part) else part.split()
            read.append(runs)
        fixed = {"": b""} | self.added
        found, new = self.known.find_all(set().union(*read).difference(fixed))
        encoded = self.runs(new)
        found |= encoded | fixed
        self.known.keep_all({run: tokens for run, tokens in encoded.items() if len(run) <= LONG_RUN})
        return [b"".join(map(found.__getitem__, runs)) for runs in read]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@functools.cache
def coder(path: str) -> Coder:
    return Coder(path)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """Replace ``text_col`` by ``ids``, an array of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            for a, b in slices(map(len, texts), SLICE_CHARS):
                part = batch.slice(a, b - a)
                packed = coder(path).encode(texts[a:b])
                offsets = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                yield pa.RecordBatch.from_pydict({name: part.column(name) for name in names} | {"ids": ids})

    docs = docs if text_col == "ids" else docs.drop("ids")
    names = [name for name in docs.columns if name != text_col]
    return docs.mapInArrow(run, _with(docs.drop(text_col), "ids", T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the labels of ``ids`` joined by blanks; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("ids").value_lengths().fill_null(0).to_pylist()
            for a, b in slices(sizes, SLICE_TOKENS):
                part = batch.slice(a, b - a)
                ids = part.column("ids").flatten().to_numpy().tolist()
                ends = np.cumsum([0, *sizes[a:b]]).tolist()
                texts = [coder(path).decode(ids[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({name: part.column(name) for name in names} | {"decoded": pa.array(texts, pa.string())})

    tokens = tokens.drop("decoded")
    names = tokens.columns
    return tokens.mapInArrow(run, _with(tokens, "decoded", T.StringType()))
