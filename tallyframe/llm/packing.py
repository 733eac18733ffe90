"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Every document becomes token ids plus one end id and is cut into pieces of at most `capacity` ids; all
pieces but a document's last are full and fill a sequence each. Pieces are dealt into random groups of
about `group_bytes` of text by a hash, so a hot source or a group of copies spreads evenly and a group's
memory is bounded whatever the documents' lengths; each group is packed on its own by first-fit
decreasing. The tournament tree keeps the largest free capacity below each node, so the first bin that
fits is found in log time.

Cases: null text counts as empty (a document of the end id alone); a null doc_id is kept and
hashed as null; equal lengths are ordered by (doc_id, start), repeated rows are packed each on their
own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import clear_of, map_columns, on_lines, ready, table, text_of, word_codes

CAPACITY = 2048
END_ID = 1
#: Bytes of text (and one for each document) that a group holds on average; a byte makes a token at most.
GROUP_BYTES = 12 << 20
#: Entries of a worker's memo of encoded units; when it is full, only the units of the slice at hand stay.
MEMO = 500_000
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 6 << 20

PIECE = "doc_id long, start long, length long, doc_tokens long, token_bytes binary, number long"
_state: dict = {}


class Memo:
    """Ids of strings: those of the string with the number k are ids[starts[k]:starts[k] + sizes[k]]."""

    def __init__(self, limit: int = MEMO):
        self.limit, self.numbers = limit, {}
        self.starts = self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def gathered(self, at: np.ndarray) -> np.ndarray:
        return self.ids[spread(self.starts[at], self.sizes[at])]

    def places(self, keys: list[str], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of distinct keys; make() gives the ids of new ones on end and their sizes."""
        get = self.numbers.get
        at = np.array([get(k, -1) for k in keys], dtype=np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(self.numbers) + len(fresh) > self.limit and self.numbers:
            found = np.flatnonzero(at >= 0)
            kept = at[found]
            self.ids, self.sizes = self.gathered(kept), self.sizes[kept]
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.numbers = {keys[i]: k for k, i in enumerate(found.tolist())}
            at[found] = np.arange(len(found))
        if len(fresh):
            new = [keys[i] for i in fresh.tolist()]
            ids, sizes = make(new)
            first = len(self.starts)
            self.numbers.update(zip(new, range(first, first + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
            at[fresh] = np.arange(first, first + len(new))
        return at


class WordEncoder:
    """Encodes texts with a BPE tokenizer that lower-cases, splits into units and marks the end of each unit.

    Distinct words (runs without white space) of a slice are split into units once, and units that are not
    remembered from slices before are encoded; the ids of texts are then gathered by number. This holds for tokenizers of the known NORMALIZER and
    SPLITTER and for texts without ODD characters, on which lower case, composition and white space mean
    the same to all parts; any other text, and every text of another tokenizer, goes to the tokenizer whole.
    """

    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    UNIT_END = "</w>"
    ODD = r"[^\x20-\x7E\n\t\rÀ-ÖØ-öø-ÿ]|<\|(?:start|end)oftext\|>"
    UNITS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+|\n")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        splits = [x for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        model = parts["model"]
        self.known = parts["normalizer"] == self.NORMALIZER and [x["pattern"] for x in splits] == [{"Regex": self.SPLITTER}] and model["type"] == "BPE" and model["end_of_word_suffix"] == self.UNIT_END and parts["post_processor"] is None
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[k for word, k in vocab.items() if word.endswith(self.UNIT_END)]] = True
        self.memo = Memo()

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units on end, number of ids of each): a thousand units a call, told apart by their last ids."""
        texts = [" ".join(units[lo : lo + 1000]) for lo in range(0, len(units), 1000)]
        got = [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(units):  # not a tokenizer that ends every unit: one by one
            each = [self.whole(u) for u in units]
            return np.concatenate(each), np.asarray([len(x) for x in each], dtype=np.int64)
        return ids, np.diff(ends, prepend=0)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words on end, number of ids of each)"""
        units = self.UNITS.findall(on_lines(words).lower())
        distinct = dict.fromkeys(units)
        distinct.pop("\n", None)
        names = list(distinct)
        distinct = dict(zip(names, range(len(names)), strict=True)) | {"\n": -1}
        codes = np.array(list(map(distinct.__getitem__, units)), dtype=np.int64)
        breaks = codes < 0
        owner = np.cumsum(breaks)[~breaks]  # the word of each unit
        own = self.memo.places(names, self.encoded)[codes[~breaks]]
        return self.memo.gathered(own), np.bincount(owner, self.memo.sizes[own], minlength=len(words)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids of each); no text is null."""
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False) if self.known else np.ones(len(texts), bool)
        plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts) if odd.any() else texts
        codes, words, first = word_codes(plain)
        ids, sizes = self.words(words)
        lengths = sizes[codes]
        out = ids[spread((np.cumsum(sizes) - sizes)[codes], lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[first]
        if not odd.any():
            return out, np.diff(bounds)
        parts = [self.whole(texts[i].as_py()) if odd[i] else out[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.asarray([len(x) for x in parts], dtype=np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def encoder(path: str) -> WordEncoder:
    if _state.get("path") != path:
        _state.update(path=path, encoder=WordEncoder(path))
    return _state["encoder"]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its ids as unsigned little-endian 32-bit integers in token_bytes.

    number tells pieces of one slice apart that agree in all else, as those of rows without doc_id may.
    """

    def run(docs: pa.Array, texts: pa.Array) -> list:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, sizes = encoder(tokenizer).encode(texts)
        ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
        sizes = sizes + 1
        pieces = -(-sizes // capacity)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        start = spread(np.zeros(len(sizes), np.int64), pieces) * capacity
        length = np.minimum(sizes[owner] - start, capacity)
        offsets = np.concatenate([[0], np.cumsum(length)]).astype("<i4") * 4
        body = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        return [docs.take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(sizes[owner]), body, pa.array(np.arange(len(owner)))]

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_columns(chosen, run, PIECE, raw=True, size=ENCODE_BYTES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; items must come in falling order. Bins are numbered in order of opening."""
    n = len(lengths)
    leaves = 1 << max(0, math.ceil(math.log2(max(1, n))))
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i, need in enumerate(lengths.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < need:
                k += 1
        bins[i], offsets[i] = k - leaves, capacity - tree[k]
        tree[k] -= need
        k //= 2
        while k:
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k //= 2
    return bins, offsets


def groups_of(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """The number of groups for these documents."""
    size = docs.agg(F.sum(F.octet_length(text_of(docs)).cast("long") + 1).alias("n")).first()["n"] or 0
    return max(1, math.ceil(size / group_bytes))


def pack_pieces(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, number and any other columns); number goes.

    sequence_id = group * 2^32 + bin. Groups are dealt by a hash of id, place, length and number, so neither rows
    without doc_id nor copies of one row meet in one group.
    """
    ready(pieces.sparkSession)
    names = [c for c in pieces.columns if c != "number"]
    key, *_ = clear_of(pieces, "_group")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        group["sequence_id"] = (int(group[key].iloc[0]) << 32) + bins
        group["offset"] = offsets
        return group[[*names, "sequence_id", "offset"]]

    keyed = pieces.withColumn(key, F.pmod(F.xxhash64("doc_id", "start", "length", "number", F.lit(7)), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names) + ", sequence_id long, offset long"
    return keyed.groupBy(key).applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Digests of all pieces with their places: the packed table without the ids themselves."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = token_pieces(docs, path, capacity)
    light = pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "number")
    return pack_pieces(light, groups_of(docs), capacity)


def op4_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
