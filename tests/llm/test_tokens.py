import base64
import random

import pytest

public = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from tidemark.llm import tokens  # noqa: E402

PATH = public.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = [
    "", " ", "\n", "a", "it's we'll '' 's x's  's \n's 's", " 's\t'd", "a  b   c", "x \n y\n\n", "<|endoftext|> don't", "é̀ 漢字かな 123٣½", "a b  c", "'re'ving 'llama'mx",
    "\u0000 a\u0000", "ﷺ 🏳️‍🌈 zz", "tab\t\tx", "   ", "end  ", "　x", "don''t 'S", "9" * 300, "ab" * 5000, "​​x",
]


def test_same_as_public_library():
    own = reference()
    rng = random.Random(5)
    alphabet = list("ab sStrevlmd''  \n\t.,-1é漢  🙂<|>")
    cases = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    got = tokens.encode_lists(cases, PATH).to_pylist()
    for text, ids in zip(cases, got):
        assert ids == own.encode_ordinary(text), repr(text)
        assert tokens.decode(ids, PATH) == text


def test_table_with_nulls_and_clashing_names(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "Hello there", 7), (3, "Hello there", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_table(df).collect())
    hello = reference().encode_ordinary("Hello there")
    assert got == [(1, []), (2, []), (3, hello), (3, hello)]
    assert sorted((r.doc_id, r.tokens) for r in tokens.count_table(df).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert tokens.encode_table(df.limit(0)).count() == 0
