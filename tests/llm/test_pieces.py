import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidewatch.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(PATH)


def test_same_as_the_library(vocabulary):
    own, library = pieces.Pieces(vocabulary), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    long = [p.replace("▁", " ") for p in vocabulary.pieces[300:] if len(p) > 1]

    def text():
        kind = rng.random()
        if kind < 0.4:
            return "".join(rng.choice(long) for _ in range(rng.randint(1, 6)))
        if kind < 0.7:
            return "".join(rng.choice("etaoinshrdlu  \n\té日ß,.'-") for _ in range(rng.randint(0, 30)))
        return "".join(chr(rng.choice([rng.randint(32, 127), rng.randint(160, 600), rng.randint(0x4E00, 0x4EFF), 0x1F600, 0, 0x2581])) for _ in range(rng.randint(0, 12)))

    texts = [text() for _ in range(3000)] + ["", None, " ", "  ", "a" * 3000, "e " * 2000]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(t or ""), t
        assert own.decode(ids) == (t or "").replace("▁", " ")


def test_unigram_is_the_best_path():
    letters = "ab▁"
    rng = random.Random(5)
    names = sorted({*letters, *("".join(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(12))})
    names = [n for n in names if "▁" not in n[1:]]
    v = pieces.Vocabulary(["<unk>", *names], [0.0, *[-rng.uniform(1, 9) for _ in names]], [False] + [True] * len(names), [], 0, False, False).ranked()
    own = pieces.Pieces(v)
    score = dict(zip(v.pieces, v.scores))
    for n in range(1, 7):
        for w in ("".join(x) for x in itertools.product("abc", repeat=n)):
            best = {0: 0.0}
            for i in range(1, n + 1):
                steps = [best[j] + score[w[j:i]] for j in range(i) if w[j:i] in score]
                best[i] = max(steps) if w[i - 1] in score else best[i - 1] + own.unknown_score
            ids = own.encode([w])[0]
            got = sum(v.scores[i] if i else own.unknown_score for i in ids.tolist())
            assert np.isclose(got, best[n]), w


def test_rows(spark, odd, empty, vocabulary):
    more = odd.selectExpr("*", "1 AS ids", "2 AS pieces")
    got = pieces.encode_pieces(more, vocabulary)
    assert got.columns == ["doc_id", "text", "lang", "pieces", "ids", "n_pieces", "ids_crc32"]
    back = pieces.decode_pieces(got, vocabulary).collect()
    assert len(back) == 9 and all(r.decoded == (r.text or "") for r in back)
    assert pieces.encode_pieces(empty, vocabulary).count() == 0
