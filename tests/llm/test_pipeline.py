"""The pipeline and the packing query against plain Python versions of their stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from drillbook.llm import toxicity as tx
from drillbook.llm.queries import QUERIES
from drillbook.llm.shared import read
from tests.llm.frames import awkward, documents, sentence
from tests.llm.test_lines import brute as without_lines
from tests.llm.test_mixing import brute_targets, size
from tests.llm.test_queries import FOLDER
from tests.llm.test_toxicity import LABELS, corpus


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def pieces(rows, tokenizer):
    """(doc_id, piece, start, length, ids_crc32) of rows of (doc_id, text, source)."""
    made = []
    for i, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            made.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(made, key=repr)


def packed(frame):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return sorted((tuple(row) for row in frame.select(*names).collect()), key=repr)


def shingles(text):
    words = text.split()
    n = min(5, len(words))
    return Counter(tuple(words[at : at + n]) for at in range(len(words) - n + 1)) if words else Counter()


def without_near_dups(rows):
    """Classes of links of likeness 0.8 between any two texts; the first document of each."""
    sets = [shingles(text) for _, text, _ in rows]
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            alike = rows[a][1] == rows[b][1]
            if not alike and sets[a].keys() & sets[b].keys():
                common = (sets[a] & sets[b]).total()
                alike = common >= 0.8 * (sets[a].total() + sets[b].total() - common) - 1e-9
            if alike and of[a] != of[b]:
                of = [of[b] if one == of[a] else one for one in of]
    classes = defaultdict(list)
    for row, one in zip(rows, of):
        classes[one].append(row)

    def rank(row):
        return row[0] is None, row[0] or 0, hashlib.md5(row[1].encode()).digest()

    return [min(own, key=rank) for own in classes.values()]


def mixed(rows):
    """Copies by source: whole rounds, then rows by hash key up to the budget, the last one cut."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[2]].append(row)
    sizes = {source: sum(size(text) for _, text, _ in own) for source, own in by_source.items()}
    targets, made = brute_targets(sizes), []
    for source, own in by_source.items():
        rounds, rest = divmod(min(math.floor(targets[source] + 0.5), 3 * sizes[source]), sizes[source] or 1)

        def key(row):
            name = "mix" if row[0] is None else f"mix:{row[0]}"
            return hashlib.md5(name.encode()).hexdigest(), size(row[1])

        for i, text, _ in sorted(own, key=key):
            if not size(text):
                continue
            made += [(i, text, source)] * rounds
            taken = min(rest, size(text))
            rest -= taken
            if taken == size(text):
                made.append((i, text, source))
            elif taken:
                words = re.findall(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", text)
                made.append((i, "".join(words[:taken]), source))
    return made


def fixture():
    """Awkward rows, toxic ones, a line of a dozen documents, near copies, control characters."""
    rng = random.Random(5)
    toxic, labels = corpus(n=200)
    rows = awkward(7) + [(1000 + i, text, "abc"[i % 3]) for i, text, _ in toxic]
    rows += [(2000 + i, f"{sentence(rng, 20)}\n Common LINE \n{sentence(rng, 9)}", "b") for i in range(12)]
    base = sentence(rng, 200).split()
    for i in range(12):
        copy = list(base)
        copy[rng.randrange(200)] = "changed"
        rows.append((3000 + i, " ".join(copy), "a"))
    rows += [(4000 + i, f"a{chr(i)}b {chr(i)}{chr(i)}! {sentence(rng, 6)}", "c") for i in range(0x100)]
    return rows, [(1000 + i, quality, label) for i, quality, label in labels]


def test_pipeline_equals_plain_python(spark, tokenizer, tmp_path):
    rows, labels = fixture()
    docs, labelled = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")
    scored = tx.score_toxicity(docs, tx.fit(docs, labelled)).collect()
    toxic = {row["doc_id"] for row in scored if row["score"] >= 0.7}
    clean = [row for row in rows if row[0] not in toxic]
    assert 0 < len(clean) < len(rows)
    sources = [source for _, _, source in clean]
    lined = [(i, text, source) for (i, text, *_), source in zip(without_lines(clean, 10), sources)]
    assert sum(one[1] != (other[1] or "") for one, other in zip(lined, clean)) >= 12
    distinct = without_near_dups(lined)
    assert len(distinct) <= len(lined) - 11
    want = pieces(mixed(distinct), tokenizer)
    assert packed(corpus_pipeline.run(spark, str(tmp_path))) == want


def test_packing_query_holds_the_ids_of_every_document(spark, tokenizer):
    rows = [(row["doc_id"], row["text"], None) for row in read(spark, FOLDER, "documents").collect()]
    assert packed(QUERIES["op3_packing"](spark, FOLDER)) == pieces(rows, tokenizer)
