"""Forced boundaries: which places are cut, and that the ids are the library's."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from driftmap.llm import bpe
from driftmap.llm import words as w

PARTS = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "a", "é", "Z", "1", "٣", "#", "$", "<|endoftext|>", "<|endof", "🙂", "中", "'s", "\x1c", "\x00", "\x7f", "½", "’"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def encoded(codec, texts):
    out = []
    for _, _, data, bounds in w.slices(pa.array(texts)):
        ids, counts = bpe.encode_slice(codec, data, bounds)
        at = np.concatenate([[0], np.cumsum(counts)])
        out += [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)]
    return out


def test_ids_of_adversarial_texts(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(5000)]
    assert encoded(bpe.load(), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_forced_pair_is_cut(library):
    codec = bpe.load()
    text = "wqzk of the vjxq ##'; naïve 中文 🙂 end".encode()
    data = np.frombuffer(text, np.uint8)
    pairs = codec.forced[data[:-1].astype(int) * 256 + data[1:]]
    starts = set(bpe.cuts(codec, data, np.array([0, len(data)])).tolist())
    assert set((np.flatnonzero(pairs) + 1).tolist()) <= starts
    # some stand where the pre-tokenizer doesn't cut, and without the table they are gone
    without = set(bpe.cuts(codec._replace(forced=np.zeros(65536, bool)), data, np.array([0, len(data)])).tolist())
    assert starts - without
    # were every pair held to be forced, the ids would be other ones
    assert encoded(codec._replace(forced=np.ones(65536, bool), known={}), ["the end"]) != encoded(codec, ["the end"])


def test_fragments_are_independent(library):
    codec = bpe.load()
    for word in ("wqzk", "vjxqzzthe", "中文字", "naïveté", "🙂🙂"):
        data = np.frombuffer(word.encode(), np.uint8)
        starts = [*bpe.cuts(codec, data, np.array([0, len(data)])).tolist(), len(data)]
        joined = [i for a, z in zip(starts, starts[1:], strict=False) for i in codec.fragment(data[a:z].tobytes())]
        assert joined == library.encode(word, add_special_tokens=False).ids


def test_other_options_are_refused(tmp_path):
    import public_tokenizers

    spec = json.load(open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8"))
    for part, key, value in (("pre_tokenizer", "add_prefix_space", True), ("model", "ignore_merges", True), ("model", "dropout", 0.1)):
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps(spec | {part: spec[part] | {key: value}}), encoding="utf-8")
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.load(str(path))
