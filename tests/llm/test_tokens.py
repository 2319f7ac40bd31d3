import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import coder, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 5000])
@pytest.mark.parametrize("v", [3, 300, 50_000])
def test_round_trip(n, v):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, v, n), np.minimum(rng.geometric(0.3, n) - 1, v - 1), np.zeros(n, int)):
        assert (coder.decode(coder.encode(ids, v)) == ids).all()


def test_repetition_is_coded_well():
    ids = np.tile(np.random.default_rng(1).integers(0, 40_000, 500), 200)
    assert len(coder.encode(ids, 49_408)) < len(ids) / 2
    many = np.random.default_rng(2).zipf(1.5, 200_000) % 5000
    assert len(coder.encode(many, 49_408)) < len(many) * 1.3


def test_damage_is_found():
    block = bytearray(coder.encode(np.arange(500), 1000))
    for at in (0, 8, 30, len(block) - 1):
        bad = block.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(bad))
    with pytest.raises(ValueError):
        coder.encode(np.array([5]), 5)


def test_encoder_is_the_tokenizer():
    library, own = Tokenizer.from_file(PATH), tokens.Encoder(PATH, remember=50)
    rng = random.Random(1)
    pool = list("abcAZİſ'’.,;!éÉß²½1\t\n \x1c\x85 ̸́ΣςλǅـあＡ<|>-_~`ªµÿĀŁŉ") + ["<|endoftext|>", "'s", "'re", "Σ."]
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert own(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert own(None).tolist() == []


def test_files(spark, odd, empty, tmp_path):
    library = Tokenizer.from_file(PATH)
    for name, docs in (("odd", odd.repartition(3)), ("empty", empty)):
        path = str(tmp_path / name)
        tokens.write_blocks(docs, path, lambda: tokens.Encoder(PATH), block_ids=64)
        got = sorted(tokens.read_documents(spark, path).collect(), key=lambda r: r.start)
        want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        assert [r.key for r in got] == [r.doc_id for r in want]
        start = 0
        by_key = {r.doc_id: r.text for r in want}
        for r in got:
            ids = library.encode(by_key[r.key] or "", add_special_tokens=False).ids + [1]
            assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)


def test_the_format_stays():
    """Blocks that were written before can be read: the bytes of a block are fixed."""
    ids = np.minimum(np.arange(1, 20_001) ** 2 % 977, 5_000) % 300
    assert zlib.crc32(coder.encode(ids, 50_000)) == 2253073741
