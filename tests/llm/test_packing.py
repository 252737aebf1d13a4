import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from drillbook.llm import fingerprints, packing
from drillbook.llm.shared import Scratch, hold
from tests.llm.frames import awkward, documents, with_clashing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_ids_equal_the_tokenizer(tokenizer):
    letters = "abcXYZ ,.'\"s t re 're 's don't!?é Éß ² _ 12 \n\t\x1cİ \xa0 漢字 ̇ <|endoftext|> º µ * $%"
    rng = random.Random(1)
    texts = ["", "a b", "x <|endoftext|> y", "don't stop_it 3.5 ...,, é"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids = packing.WordIds(PATH)
    for start in range(0, len(texts), 100):
        some = texts[start : start + 100]
        for text, got in zip(some, ids.many(some)):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(got, "<u4").tolist() == want, text


def test_control_characters_keep_their_ids(tokenizer):
    letters = [chr(i) for i in range(0x100)] + list("ab .!'")
    rng = random.Random(2)
    texts = ["a\x7f", "\x7f\x7f!", "a\x00b", "\x1b[0m red\x1b[1m", "\x08", "\x00,", "\x0e\x1b"]
    texts += [form.format(chr(i)) for i in range(0x100) for form in ("{0}", "a{0}", "{0}b", "a {0}{0}! b", "é{0}")]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids = packing.WordIds(PATH)
    for text, got in zip(texts, ids.many(texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text


def check(rows, found, tokenizer, capacity):
    pieces, places = defaultdict(list), defaultdict(list)
    for row in found:
        pieces[row["doc_id"]].append(row)
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    texts = defaultdict(list)
    for i, text, _ in rows:
        texts[i].append(text or "")
    assert set(pieces) == set(texts)
    for i, own in texts.items():
        want = []
        for text in own:
            ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
            for piece, at in enumerate(range(0, len(ids), capacity)):
                part = np.array(ids[at : at + capacity], "<u4")
                want.append((piece, at, len(part), zlib.crc32(part.tobytes())))
        got = [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]]
        assert sorted(got) == sorted(want)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_whole_documents_are_packed(spark, tokenizer):
    rows = awkward(3, 120)
    found = packing.pack(with_clashing(documents(spark, rows)), PATH, 256).collect()
    sequences = check(rows, found, tokenizer, 256)
    assert sequences <= 1.05 * sum(r["length"] for r in found) / 256 + 2


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def best_fit_decreasing(sizes, capacity):
    free, bins = [], 0
    for size in sorted(sizes, reverse=True):
        fits = [gap for gap in free if gap >= size]
        gap = min(fits) if fits else capacity
        if fits:
            free.remove(gap)
        else:
            bins += 1
        free.append(gap - size)
    return bins


@pytest.mark.parametrize(
    "sizes",
    [
        [7] * 900,
        [random.Random(1).randint(1, 99) for _ in range(1500)],
        [51] * 300 + [49] * 300,
        [60, 40] * 200 + [1] * 500,
        [34] * 400,
    ],
)
def test_as_few_as_best_fit_decreasing(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, size int")
    found = packing.best_fit_bins(rows, Scratch(spark, "test"), 100).collect()
    assert sorted(r["id"] for r in found) == list(range(len(sizes)))
    bins = defaultdict(list)
    for r in found:
        bins[r["bin"]].append((r["offset"], sizes[r["id"]]))
    for spans in bins.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 100
    assert len(bins) <= best_fit_decreasing(sizes, 100) * 1.02 + 1


def test_size_ranks_are_dense(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else 2) for i in range(1000)], "id long, size int")
    ranked = packing.size_ranks(rows, "size", "id", 1000).collect()
    for size in (1, 2):
        own = sorted(r["rank"] for r in ranked if r["size"] == size)
        assert own == list(range(len(own)))


def test_ranks_of_shrunk_gaps_stay_dense():
    draw = random.Random(5)
    sizes = {size: [0, draw.randint(1, 30)] for size in range(1, 60)}
    bins = {(gap, rank): draw.randint(0, 9) for gap in (7, 20, 45, 90) for rank in range(12)}
    gaps = {gap: 12 for gap in (7, 20, 45, 90)}
    for _ in range(4):
        segments = packing.sweep(sizes, gaps)
        filled = defaultdict(int)
        for size, _first, taken, gap, first, per_bin in segments:
            for turn in range(taken):
                filled[gap, first + turn // per_bin] += size
        smallest = min(size for size, (_, n) in sizes.items() if n)
        moves, gaps = packing.moved(segments, gaps, smallest)
        after = {}
        for gap, first, n, new_gap, shift in moves:
            for rank in range(first, first + n):
                assert new_gap == gap - filled[gap, rank] >= smallest
                assert (new_gap, rank + shift) not in after
                after[new_gap, rank + shift] = bins[gap, rank]
        assert len(after) == sum(gap - filled[gap, rank] >= smallest for gap, rank in bins)
        assert set(after) == {(gap, rank) for gap, n in gaps.items() for rank in range(n)}
        bins = after


def test_all_rounds_are_read_in_one_scan(spark):
    """A scan per round made plans, and the driver's memory, grow with the rounds."""
    sizes = [random.Random(1).randint(1, 99) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, size int")
    found = packing.best_fit_bins(rows, Scratch(spark, "test"), 100)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_a_worker_remembers_for_one_operator():
    """Workers outlive stages: what packing keeps must not stand beside the next operator's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    hold(packing._word_ids.cache_clear)
    packing._word_ids(path).many(["some words"])
    hold(packing._word_ids.cache_clear)
    assert packing._word_ids(path).young
    fingerprints._word_hashes.clear()
    fingerprints.shingle_hashes("other words here")
    assert packing._word_ids.cache_info().currsize == 0
    hold()
    assert not fingerprints._word_hashes
