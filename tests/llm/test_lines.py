import hashlib

import pytest
from pyspark.sql import functions as F

from drillbook.llm import lines
from tests.llm.frames import awkward, documents, with_clashing


def brute(rows, least):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    result = []
    for i, text, _ in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (key(x) and len(holders[key(x)]) >= least)]
        result.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return result


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("least", [2, 3, 12])
def test_equals_brute_force(spark, least):
    rows = awkward()
    rows += [(500 + i, f"own {i}\n  Shared LINE\t\nÄ shared\n" + "x\n" * (i % 3), "s") for i in range(15)]
    found = lines.drop_repeated_lines(with_clashing(documents(spark, rows)), least)
    got = [tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert ordered(got) == ordered(brute(rows, least))


def test_keeps_columns_and_replaces_clashing_results(spark):
    frame = documents(spark, [(1, "a", "s")]).withColumn("n_lines", F.lit("old"))
    found = lines.drop_repeated_lines(with_clashing(frame), 1)
    assert found.first()["key"] == "x"
    assert found.first()["n_lines"] == 1 and found.first()["text"] == ""


def test_empty_table(spark):
    assert lines.drop_repeated_lines(documents(spark, [])).count() == 0


def test_short_keys_stay(spark):
    frame = documents(spark, [(i, "ab\nabcd", "s") for i in range(3)])
    assert {r["text"] for r in lines.drop_repeated_lines(frame, 2, 3).collect()} == {"ab"}


def test_digest_of_a_text_without_lines_left():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
