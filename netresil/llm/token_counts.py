"""Token counts of a byte-level BPE by the whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded by itself:
those that come back as one token are proven whole. A text is cut into
pre-tokens by the tokenizer's own pattern; a pre-token that is proven whole
counts one, and only the others are merged by the tokenizers library.

Road-network records hold no running text, so the operator is general.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netresil.llm.text import bound_batches

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens remembered per worker, and the longest one remembered (characters).
REMEMBERED, LONGEST = 400_000, 48


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: bytes
    that print as they are stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    model = json.loads(tokenizer_json)
    special = {t["content"] for t in model["added_tokens"]}
    letters = byte_letters()
    strings = []
    for entry in model["model"]["vocab"]:
        if entry in special:
            continue
        try:
            text = bytes(letters[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if regex.fullmatch(PATTERN, text):
            strings.append(text)
    tokenizer = Tokenizer.from_str(tokenizer_json)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1)


class Counter(dict):
    """Pre-token -> number of tokens; what is not proven whole is merged when first met."""

    def __init__(self, tokenizer: Tokenizer, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenizer, self.whole = tokenizer, whole

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED + len(self.whole):
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


class TokenCounter:
    """Built on the driver from the tokenizer's file, used in every task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        model = json.loads(self.json)
        kind = model["pre_tokenizer"]
        if model["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind.get("use_regex", True) or model["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.whole = whole_tokens(self.json)
        self.counter = None

    def __getstate__(self):
        return self.__dict__ | {"counter": None}

    def ready(self):
        if self.counter is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.counter = Counter(Tokenizer.from_str(self.json), self.whole)
            self.find = regex.compile(PATTERN).findall
            self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))).split if self.specials else None
        return self

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get = self.counter.__getitem__
        if self.split and any(s in text for s in self.specials):
            parts = self.split(text)
            return len(parts) - 1 + sum(sum(map(get, self.find(p))) for p in parts)
        return sum(map(get, self.find(text)))


def token_counts(texts: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``texts`` with ``n_bytes`` (UTF-8) and ``n_tokens``.

    Counts are those of the tokenizers library without begin, end or padding
    tokens and without truncation; strings of special tokens inside a text
    count as one token each, the library's default. Null and empty texts have
    none. Columns with the new names are replaced.
    """
    bound_batches(texts)
    counter = TokenCounter(tokenizer_path)
    keep = [c for c in texts.columns if c not in ("n_bytes", "n_tokens")]
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes")
    held = texts.select(*keep, n_bytes, F.col(text_col).alias("__body"))
    keep = [*keep, "n_bytes"]
    shared = texts.sparkSession.sparkContext.broadcast(counter)  # bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value.ready()
        for batch in batches:
            column = batch.column("__body")
            n = pa.array([ready.count(t) for t in column.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n], names=[*keep, "n_tokens"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*keep).schema.fields), "n_tokens bigint"])
    return held.mapInArrow(count, ddl)
