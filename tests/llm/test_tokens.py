import random

import public_tokenizers
import pytest
from tallyloom.llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_against_the_library(spark):
    rng = random.Random(1)
    alphabet = [*"abcde ABC 123 '’", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "　", "é", "漢", "🙂", "'s", "'ll", "<|endoftext|>", "\x1c", "ß", "!!", "...", "don't ", "́", "٣"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(600)] + ["a" * 5000, " " * 3000, "ab" * 3000, "", "\r\n" * 50]
    library = Tokenizer.from_file(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in tokens.token_counts(rows, PATH).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (want[i] > 512) for i, t in enumerate(texts))


def test_edges(docs, no_docs):
    got = tokens.token_counts(docs, PATH).collect()
    assert len(got) == docs.count()
    assert {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (3, 4)} == {(0, 0)}
    assert tokens.token_counts(no_docs, PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.Counter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_added_tokens_with_spaces_are_refused():
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["added_tokens"] = [dict(spec["added_tokens"][0], content="two words")] if spec.get("added_tokens") else [{"content": "two words", "single_word": False, "lstrip": False, "rstrip": False}]
    with pytest.raises(ValueError):
        tokens.Counter(json.dumps(spec))
