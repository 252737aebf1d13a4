import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from drillbook.llm import fingerprints, tokens, toxicity
from tests.llm.frames import awkward, documents, with_clashing

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram(vocabulary, byte_fallback):
    made = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return made


@pytest.fixture(scope="module")
def reference():
    return unigram(tokens.unigram_vocabulary(PATH), True)


def test_counts_equal_the_tokenizer(reference):
    counter = tokens.PieceCounter(tokens.unigram_vocabulary(PATH))
    rng = random.Random(2)
    letters = "the and ing tion é ß 漢 字 \U0001f600 \n \t , . 1 2 ▁ zzq"
    for _ in range(3000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25))).replace(" ", "")
        word = word.replace("▁", "")
        if word:
            want = len(reference.encode(word, add_special_tokens=False).ids)
            assert counter.count(tokens.MARK + word) == want, repr(word)


def test_ties_go_to_the_longer_last_piece():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]
    vocabulary += [("aab", -3.0), ("ba", -2.0), ("bab", -3.0)]
    made, counter = unigram(vocabulary, False), tokens.PieceCounter(vocabulary)
    rng = random.Random(3)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert counter.count(tokens.MARK + word) == len(made.encode(word).ids), word


def test_whole_texts(spark, reference):
    rows = awkward()
    found = tokens.count_tokens(with_clashing(documents(spark, rows)), PATH).collect()
    want = [
        (i, len(reference.encode(text, add_special_tokens=False).ids) if text else 0)
        for i, text, _ in rows
    ]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert tokens.count_tokens(documents(spark, [])).count() == 0


def test_workers_keep_no_long_words():
    """Texts without blanks: a word may be a whole text, so caches bounded by words alone would not be."""
    rng = random.Random(8)
    before = len(fingerprints._word_hashes)
    known = {}
    counter = tokens._counter(public_tokenizers.path("piece_bpe_32k.model"))[1]
    field = toxicity.Field(weights={"bad": 1.0})
    for _ in range(50):
        text = "".join(rng.choice("abcdef") for _ in range(20_000)) + " short"
        fingerprints.shingle_hashes(text)
        toxicity._scored(field, [text], known)
    assert len(fingerprints._word_hashes) <= before + 1
    assert set(known) == {"short"} and not any(len(word) > 100 for word in counter)
