import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from methylake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def official():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_codec(official):
    rng = random.Random(1)
    texts = ["", "  a  b \n\n c", "<|endoftext|>x <|endoftext|> y<|endoftext", "a" * 3000, " \t x", "naïve 日本語 🎉🎉", " " * 50, "1234567890 " * 30, "it's we'll  x", "ab" * 700, " x  y"]
    texts += ["".join(rng.choice("ab c\n1é'$") for _ in range(300)) for _ in range(100)]
    c = bpe.Codec(PATH)
    for t in texts:
        want = official.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == want
        assert c.decode(want) == official.decode(want, skip_special_tokens=False) == t


def test_trees_agree():
    """The matrix of trees and the single tree are two forms of one algorithm."""
    rng = random.Random(2)
    c = bpe.Codec(PATH)
    pieces = [bytes(rng.choice(b"abcdehinorst ") for _ in range(rng.randrange(2, 250))) for _ in range(60)]
    assert c.merge_rows(pieces) == [c.merge_long(p) for p in pieces]


def test_tables(docs, corpus, empty, clashing, official):
    want = sorted((str(i), len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in corpus for x in [official.encode(t or "", add_special_tokens=False).ids])
    got = bpe.digest_table(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    full = bpe.encode_table(clashing, PATH, keep=("doc_id", "source")).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in full) == [x[:2] for x in want]
    assert bpe.digest_table(empty, PATH).count() == 0


def test_cache_generations():
    c, whole = bpe.Codec(PATH, 5), bpe.Codec(PATH)
    for k in range(20):
        t = f"word{k} again word{k // 2} the"
        assert c.encode(t) == whole.encode(t)
