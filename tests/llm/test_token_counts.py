import public_tokenizers
import pytest

from adjudica.llm import token_counts as tc
from adjudica.sources import scratch

ROWS = [
    (1, "The quick brown fox"), (2, None), (3, ""), (4, "The quick brown fox"), (5, " two  spaces "), (6, "<s> </s> <unk>"),
    (7, "é日𝄞\n\t"), (8, "word " * 50_000), (None, "x"), (1, "The quick brown fox"),
]


def expected(path, texts):
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_are_the_library_s(spark, frame, name):
    path, cache = public_tokenizers.path(name), scratch.new_path(spark, "test-cache")
    tc.new_cache(spark, cache)
    got = tc.count_tokens(frame(ROWS), path, cache, limit=4096).collect()
    want = [
        (i, len((t or "").encode()), n, n > 4096)
        for (i, t), n in zip(ROWS, expected(path, [t or "" for _, t in ROWS]), strict=True)
    ]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_only_misses_are_encoded_and_appended(spark, frame):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), scratch.new_path(spark, "test-cache")
    version = tc.tokenizer_digest(path)
    tc.new_cache(spark, cache)
    assert tc.misses(frame(ROWS), cache, version).count() == len({t or "" for _, t in ROWS})
    tc.count_tokens(frame(ROWS), path, cache, 10).collect()
    more = frame(ROWS + [(20, "new"), (21, "new")])
    assert [r.text for r in tc.misses(more, cache, version).collect()] == ["new"]
    before = spark.read.parquet(cache).count()
    tc.count_tokens(more, path, cache, 10).collect()
    assert spark.read.parquet(cache).count() == before + 1
    # A cached count is used as it is; another tokenizer version has none.
    assert tc.misses(more, cache, b"other").count() > 1
    # Digests that two jobs have appended count once.
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert tc.count_tokens(more, path, cache, 10).count() == len(ROWS) + 2


def test_empty_and_unknown(spark, frame):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), scratch.new_path(spark, "test-cache")
    tc.new_cache(spark, cache)
    assert tc.count_tokens(frame([]), path, cache, 10).count() == 0
    with pytest.raises(ValueError):
        tc._encoder("words.txt")
