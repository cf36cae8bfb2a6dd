"""Byte-level BPE as an automaton over tokens: encoding and decoding.

A merge list is compiled once, merge by merge. The automaton starts as one
state that every byte leads back to. The gadget of a merge (u, v) clones the
state that u leads to, leaves the arc v out of the clone, lets u lead to the
clone, and adds an arc labelled uv, leading where v leads, beside every arc
labelled u. After the last merge exactly one path spells any word, and its
labels are the tokens that merging in order of rank gives. (Construction after
Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA".)

An arc's target depends on its label alone, and a clone differs from its
original in one arc. So the tables are linear in the merges: per state its
original and the arc left out, per token its target and the two it joins.

Road-network records hold no running text, so the operators are general: they
take any table with a text column.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.llm.text import bound_batches
from netresil.llm.token_counts import PATTERN, byte_letters

#: Pieces a worker remembers between batches, their tokens, and arcs judged.
REMEMBERED, REMEMBERED_TOKENS, JUDGED = 800_000, 8_000_000, 1_000_000

ROOT = 0


class MergeAutomaton:
    """Transitions over tokens. ``merges`` lists (u, v, uv) as token ids, first merge first; ``alphabet`` has the tokens no merge makes."""

    def __init__(self, alphabet: list[int], merges: list[tuple[int, int, int]]):
        size = max([*alphabet, *(t for m in merges for t in m)], default=-1) + 1
        self.original, self.omitted = [ROOT], [-1]
        self.target, self.left = [ROOT] * size, [-1] * size
        #: The merge that made a token or a state; a token without arcs (made by no merge, or by one that never applies) has -1.
        self.made, self.state_made = [-1] * size, [0]
        for t in alphabet:
            self.made[t] = 0
        for rank, (u, v, joined) in enumerate(merges, 1):
            if self.made[joined] >= 0:
                raise ValueError("two merges make the same token")
            if self.made[u] < 0 or self.made[v] < 0 or not self.arc(self.target[u], v):
                continue
            before = self.target[u]
            self.original.append(before)
            self.omitted.append(v)
            self.state_made.append(rank)
            # For u = v the new arc leads where u led before.
            self.target[joined] = self.target[v]
            self.target[u] = len(self.original) - 1
            self.left[joined], self.made[joined] = u, rank

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc labelled ``token``."""
        while True:
            made = self.made[token]
            if made < 0:
                return False
            if made >= self.state_made[state]:
                if made == 0:
                    return True
                token = self.left[token]  # added beside every arc of its left part
            elif token == self.omitted[state]:
                return False
            else:
                state = self.original[state]


class Words(dict):
    """Word -> slot of its tokens; a word is encoded by the automaton when first met. A special token is the word ``(id,)``."""

    def __init__(self, labels: list[bytes], automaton: MergeAutomaton):
        super().__init__()
        self.labels, self.automaton, self.judged = labels, automaton, {}
        self.step, self.token = {}, [-1]
        for token, label in enumerate(labels):
            if token < len(automaton.made) and automaton.made[token] >= 0:
                node = 0
                for byte in label:
                    node = self.step.setdefault(node << 8 | byte, len(self.token))
                    if node == len(self.token):
                        self.token.append(-1)
                self.token[node] = token
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.starts = array("i"), array("q", [0])

    def __missing__(self, piece) -> int:
        ids = self.encode(piece)
        slot = self[piece] = len(self.starts) - 1
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        return slot

    def tokens(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts given as pieces, and where each text's begin."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        slots = np.fromiter((self[p] for pieces in texts for p in pieces), np.int64, int(counts.sum()))
        starts = np.array(self.starts)
        n = starts[slots + 1] - starts[slots]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(starts[slots] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.array(self.ids, np.int32)[at]
        edges = np.concatenate([[0], np.cumsum(counts)])
        if len(self) > REMEMBERED or len(self.ids) > REMEMBERED_TOKENS:
            self.forget()
        return ids, ends[edges]

    def encode(self, piece) -> list[int]:
        """Tokens of a word: the labels of the one path that spells it.

        The longest arc that fits is followed first. Each beginning of a word
        is spelled by one path at most, so a byte that leads nowhere is never
        tried again, and the work is linear in the word's length.
        """
        if isinstance(piece, tuple):
            return list(piece)
        word = piece.encode()
        n, step, token, judged, labels = len(word), self.step.get, self.token, self.judged, self.labels
        arc, target, size = self.automaton.arc, self.automaton.target, len(labels)
        out, untried, dead = [], [], set()
        i, state, fitting = 0, ROOT, None
        while i < n:
            if fitting is None:
                fitting, node = [], 0
                for j in range(i, n):
                    node = step(node << 8 | word[j])
                    if node is None:
                        break
                    if token[node] >= 0:
                        fitting.append(token[node])
            while fitting:
                t = fitting.pop()
                if i + len(labels[t]) in dead:
                    continue
                key = state * size + t
                taken = judged.get(key)
                if taken is None:
                    if len(judged) >= JUDGED:
                        judged.clear()
                    taken = judged[key] = arc(state, t)
                if taken:
                    out.append(t)
                    untried.append(fitting)
                    i, state, fitting = i + len(labels[t]), target[t], None
                    break
            else:
                dead.add(i)
                i -= len(labels[out.pop()])
                fitting, state = untried.pop(), target[out[-1]] if out else ROOT
        return out


class Tokenizer:
    """A tokenizer file compiled on the driver and shared by broadcast; its size is that of the vocabulary.

    Files are refused whose rules go beyond a byte-level BPE: normalizers,
    prefix spaces, dropout, unknown tokens, affixes, whole words that skip the
    merges, and added tokens that strip white space or match single words.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split, decoder = told["model"], told["pre_tokenizer"] or {}, told["decoder"] or {}
        plain = (
            model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
            and decoder.get("type") == "ByteLevel" and not told["normalizer"]
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"])
        )
        if not plain:
            raise ValueError("a plain byte-level BPE is needed")
        vocabulary, letters = model["vocab"], byte_letters()
        if not letters.keys() <= vocabulary.keys():
            raise ValueError("every byte must be in the vocabulary")
        self.specials = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special_ids = frozenset(t["id"] for t in told["added_tokens"] if t["special"])
        ids = vocabulary | self.specials
        self.labels = [b""] * (max(ids.values()) + 1)
        for entry, token in ids.items():
            known = all(c in letters for c in entry)
            self.labels[token] = bytes(letters[c] for c in entry) if known else entry.encode()
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.alphabet, self.joined = [vocabulary[c] for c in letters], [vocabulary[u + v] for u, v in pairs]
        self.automaton = MergeAutomaton(self.alphabet, [(vocabulary[u], vocabulary[v], joined) for (u, v), joined in zip(pairs, self.joined)])
        self.ready = None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def in_order(self) -> list[int]:
        """All tokens of the alphabet and the merges, whose ids must rise with the merges' ranks."""
        if any(later <= earlier for earlier, later in zip([max(self.alphabet), *self.joined], self.joined)):
            raise ValueError("the ids do not rank the merges")
        return self.alphabet + self.joined

    def words(self) -> Words:
        """The words a worker remembers, made when first asked for."""
        if self.ready is None:
            self.ready = Words(self.labels, self.automaton)
            self.find = regex.compile(PATTERN).findall
            longest_first = sorted(self.specials, key=len, reverse=True)
            self.cut = regex.compile("|".join(map(regex.escape, longest_first))).finditer if self.specials else None
        return self.ready

    def split(self, text: str | None, specials: bool) -> list:
        """Pieces of a text; null has none."""
        if not text:
            return []
        if not (specials and self.cut and any(s in text for s in self.specials)):
            return self.find(text)
        out, at = [], 0
        for m in self.cut(text):
            out += self.find(text[at : m.start()])
            out.append((self.specials[m.group()],))
            at = m.end()
        return out + self.find(text[at:])


def _ddl(df: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), added])


def encode(texts: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", specials: bool = True) -> DataFrame:
    """All columns of ``texts`` with the token ids of each whole text (array<int>).

    Ids are those of the tokenizers library without begin and end tokens,
    truncation and padding. Strings of special tokens inside a text are that
    token, or ordinary text where ``specials`` is false. Null and empty texts
    have an empty array; rows are independent, so repeated rows and ids, ties
    and null ids change nothing. A column named ``ids_col`` is replaced.
    """
    bound_batches(texts)
    keep = [c for c in texts.columns if c != ids_col]
    held = texts.select(*keep, F.col(text_col).alias(f"__{ids_col}_body"))
    shared = texts.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        words = tokenizer.words()
        for batch in batches:
            pieces = [tokenizer.split(t, specials) for t in batch.column(len(keep)).to_pylist()]
            ids, edges = words.tokens(pieces)
            column = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), column], names=[*keep, ids_col])

    return held.mapInArrow(run, _ddl(held.select(*keep), f"`{ids_col}` array<int>"))


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", output_col: str = "decoded", skip_specials: bool = False) -> DataFrame:
    """All columns of ``encoded`` with the text its token ids spell.

    The bytes that label the arcs are joined; what is not UTF-8 is replaced by
    U+FFFD as the tokenizers library does. Null ids and ids outside the
    vocabulary spell nothing; a null or empty array is the empty text. Special
    tokens spell their strings, or nothing with ``skip_specials``. A column
    named ``output_col`` is replaced.
    """
    bound_batches(encoded)
    keep = [c for c in encoded.columns if c != output_col]
    ids_of = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    held = encoded.select(*keep, ids_of.alias(f"__{output_col}_ids"))
    tokenizer = Tokenizer(tokenizer_path)
    labels = [b"" if skip_specials and t in tokenizer.special_ids else x for t, x in enumerate(tokenizer.labels)]
    shared = encoded.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One more label, of no bytes, for what is outside the vocabulary.
        lengths = np.array([*map(len, shared.value), 0], np.int64)
        starts, arcs = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(shared.value), np.uint8)
        none = len(lengths) - 1
        for batch in batches:
            column = batch.column(len(keep))
            flat = column.flatten()
            ids = np.asarray(flat.fill_null(none) if flat.null_count else flat, np.int64)
            ids = np.where((ids < 0) | (ids > none), none, ids)
            ends = np.concatenate([[0], np.cumsum(lengths[ids])])
            spelled = arcs[np.repeat(starts[ids] - ends[:-1], lengths[ids]) + np.arange(ends[-1])].tobytes()
            offsets = np.asarray(column.offsets, np.int64)
            edges = ends[offsets - offsets[0]].tolist()
            out = pa.array([spelled[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), out], names=[*keep, output_col])

    return held.mapInArrow(run, _ddl(held.select(*keep), f"`{output_col}` string"))
