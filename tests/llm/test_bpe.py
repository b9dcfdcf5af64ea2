import hashlib
import random
import struct

import pytest

from scorelark.llm import bpe

SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = bpe.read_ranks(open(bpe.default_ranks(), "rb").read())
    return bpe.BytePairCodec(ranks, bpe.default_pattern()), tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.mark.parametrize("alphabet", ["abcdetinosr", "aé ñ漢。1\x1c\x85\n\t🙂'stve", "    \n\n\ta", "%$#*|!0123456789 "])
def test_same_ids_as_the_public_library(both, alphabet):
    codec, public = both
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
        assert ids_of(codec.encode(text)) == public.encode_ordinary(text), repr(text)


def test_long_piece_and_long_text(both):
    codec, public = both
    for text in ("a" * 20_000, "theinge" * 5_000, "Und der  \n" * 120_000):
        packed = codec.encode(text)
        assert codec.decode(packed) == text.encode()
        if len(text) < 100_000:
            assert ids_of(packed) == public.encode_ordinary(text)


def test_query_rows_nulls_repeats_and_clashing_columns(spark, both):
    codec, _ = both
    rows = [(1, "Hello world", "x"), (2, None, None), (3, "", "y"), (1, "Hello world", "x"), (None, "été 12", "z")]
    got = bpe.encode(spark.createDataFrame(rows, SCHEMA), bpe.default_ranks(), bpe.default_pattern())
    want = sorted((str(i), len(codec.encode(t or "")) // 4, hashlib.sha256(codec.encode(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert all(r.round_trip for r in got.collect())
    back = bpe.decode(got, bpe.default_ranks())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, _ in rows)


def test_empty_table(spark):
    got = bpe.encode(spark.createDataFrame([], SCHEMA), bpe.default_ranks(), bpe.default_pattern())
    assert got.count() == 0 and got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
