"""Byte-level BPE by forced boundaries.

A byte pair that stands inside no token of the vocabulary is a forced boundary: no merge can
cross it, wherever it stands (in words, punctuation or characters of several bytes), and
merges on its two sides don't touch each other. Every such pair of a text is cut. The
pre-tokenizer's bounds, found from the classes of the whole text's characters before
anything is cut, are kept as well, so that fragments need no context: each is encoded on its
own by the vocabulary's merges alone, equal ones once, and the ids are put together again.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers.models import BPE

from driftmap.llm import words as w

VOCABULARY = "byte_bpe_50k.json"
#: Encoded fragments that a task remembers.
REMEMBERED = 200_000
#: Options of a tokenizer file that this encoder has; it refuses files with other ones.
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
_BEFORE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}

_LETTER, _NUMBER, _OTHER, _BLANK = range(4)
#: Endings after an apostrophe that the byte-level pre-tokenizer keeps together (fixed values).
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point in the byte-level pre-tokenizer."""
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, _OTHER, np.int8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"[\t-\r\x85\p{Z}]+")):
        for m in regex.finditer(pattern, every):
            out[[*map(ord, m[0])]] = kind
    return out


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as they are and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec(NamedTuple):
    merges: BPE
    letters: dict[int, str]
    forced: np.ndarray
    special: dict[bytes, int]
    data: np.ndarray
    offset: np.ndarray
    known: dict[int, list[int]]

    def fragment(self, piece: bytes) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return [t.id for t in self.merges.tokenize(piece.decode("latin-1").translate(self.letters))]


@functools.lru_cache(maxsize=2)
def load(path: str | None = None) -> Codec:
    """From a byte-level BPE file: its merges, its forced pairs (65,536 flags) and the bytes of its tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    plain = not spec["normalizer"] and (spec["decoder"] or {}).get("type") == "ByteLevel"
    for got, wanted in ((model, _MODEL), (before, _BEFORE), *((x, _ADDED) for x in added)):
        plain = plain and all(got.get(k, v) == v for k, v in wanted.items())
    if not plain:
        raise ValueError(f"{path} isn't a plain byte-level BPE")
    chars, vocab = _byte_of_char(), model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    tokens = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
    inside = np.zeros(65536, bool)
    for t in tokens.values():
        b = np.frombuffer(t, np.uint8).astype(np.int64)
        inside[b[:-1] * 256 + b[1:]] = True
    special = {x["content"].encode(): x["id"] for x in added}
    tokens |= {i: t for t, i in special.items()}
    size = np.zeros(max(tokens) + 1, np.int64)
    for i, t in tokens.items():
        size[i] = len(t)
    data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(size))), np.uint8)
    letters = {b: c for c, b in chars.items()}
    return Codec(BPE(vocab, merges), letters, ~inside, special, data, np.concatenate([[0], np.cumsum(size)]), {})


def pretoken_starts(chars: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer begins a new piece. chars: code points; opens: where texts begin.

    A piece is a run of one class. Of white space before something else the last character
    stands alone; if it is a space, it goes with what follows. An apostrophe that begins a
    piece and one of the endings are a piece.
    """
    n, kind = len(chars), _classes()[chars]
    new = opens.copy()
    new[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~opens[1:])
    new[last] = True
    new[last[chars[last] == 0x20] + 1] = False
    mark = np.flatnonzero((chars == 0x27) & new)
    padded, bound = np.append(chars, [0, 0, 0]), np.append(opens, [True, True, True])
    for ending in _ENDINGS:
        fits = np.ones(len(mark), bool)
        for j, c in enumerate(ending, 1):
            fits &= (padded[mark + j] == ord(c)) & ~bound[mark + j]
        there = mark[fits]
        new[there + 1] = False
        after = there + 1 + len(ending)
        new[after[after < n]] = True
    return new


def cuts(codec: Codec, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of all fragments: document bounds, special tokens, forced pairs, pieces of the pre-tokenizer."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    raw = data.tobytes()
    opens, solid = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    opens[bounds] = True
    if codec.special:
        longest = sorted(codec.special, key=len, reverse=True)
        wanted, p = re.compile(b"|".join(map(re.escape, longest))), 0
        while m := wanted.search(raw, p):
            a, p = m.span()
            if opens[a + 1 : p].any():  # parts of two documents
                p = a + 1
                continue
            opens[a] = opens[p] = True
            solid[a + 1 : p] = True
    cut = opens[:n].copy()
    cut[1:] |= codec.forced[data[:-1].astype(np.int64) * 256 + data[1:]]
    first = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    cut[first[pretoken_starts(chars, opens[first])]] = True
    return np.flatnonzero(cut & ~solid[:n])


def encode_slice(codec: Codec, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a slice, and the number of each document's ids."""
    start = cuts(codec, data, bounds)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
    end = np.append(start[1:], len(data))
    names, sample, which = np.unique(w.run_hash(w.BYTE_VALUE[data], start, end), return_index=True, return_inverse=True)
    raw, known = data.tobytes(), codec.known
    if len(known) + len(names) > REMEMBERED:
        known.clear()
    found = []
    for h, a, z in zip(names.tolist(), start[sample].tolist(), end[sample].tolist(), strict=True):
        ids = known.get(h)
        if ids is None:
            ids = known[h] = codec.fragment(raw[a:z])
        found.append(ids)
    counts = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum()))
    at = np.cumsum(counts) - counts
    each = counts[which]
    total = np.concatenate([[0], np.cumsum(each)])
    return w.ragged(ids, at[which], each), np.diff(total[np.searchsorted(start, bounds)])


def decode_slice(codec: Codec, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    size = codec.offset[ids.astype(np.int64) + 1] - codec.offset[ids]
    data = w.ragged(codec.data, codec.offset[ids], size).tobytes()
    edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:z].decode("utf-8", "replace") for a, z in zip(edge[:-1], edge[1:], strict=True)]


def _encode(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    codec = load(path)
    for b in batches:
        for lo, hi, data, bounds in w.slices(b.column("text")):
            ids, counts = encode_slice(codec, data, bounds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), w.list_array(pa.array(ids.astype(np.int32)), counts)], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    codec = load(path)
    for b in batches:
        lists = b.column("ids")
        lists = lists.fill_null([]) if lists.null_count else lists
        texts = decode_slice(codec, lists.flatten().to_numpy().astype(np.uint32), np.diff(lists.offsets.to_numpy()).astype(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _digests(batches: Iterator[pa.RecordBatch], path: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec = load(path)
    for b in batches:
        for lo, hi, data, bounds in w.slices(b.column("text")):
            ids, counts = encode_slice(codec, data, bounds)
            edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
            raw = ids.astype("<u4").tobytes()
            of_ids = [hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in zip(edge[:-1], edge[1:], strict=True)]
            of_text = [hashlib.sha256(t.encode()).hexdigest() for t in decode_slice(codec, ids, counts)]
            cols = {"doc_id": b.column("doc_id").slice(lo, hi - lo), "n_tokens": pa.array(counts), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_text)}
            if with_ids:
                cols["ids"] = w.list_array(pa.array(ids.astype(np.int32)), counts)
            yield pa.RecordBatch.from_pydict(cols)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each row of docs; a null text has no ids, special tokens in a text are taken as such. Repeated rows stay, other columns are ignored."""
    return _texts(docs).mapInArrow(lambda it: _encode(it, path), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of doc_id, ids; null ids give an empty text, bytes that aren't UTF-8 become U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, path), "doc_id bigint, text string")


_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode and then decode give, as digests, without the ids leaving their task."""
    return _texts(docs).mapInArrow(lambda it: _digests(it, path, False), _DIGESTS)


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """round_trip's columns and ids, in one pass."""
    return _texts(docs).mapInArrow(lambda it: _digests(it, path, True), _DIGESTS + ", ids array<int>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")


def op7_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
