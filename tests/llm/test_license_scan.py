import re

from tidemark.llm.license_scan import license_scan

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [p for p, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def got(df):
    return sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan(df).collect())))


def test_base_places_equal_a_plain_search(spark, odd):
    more = spark.createDataFrame([(20, "CC BY cc-by/4.0 cc by"), (21, "the GNU General Public License, version 3; all rights reserved. All Rights\nReserved"), (22, "cc  by" * 3), (23, "K cc by İ all rights reservedé")], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(more)
    assert got(both) == sorted(map(repr, ((r["doc_id"], *plain(r["text"])) for r in both.collect())))


def test_labels_of_whole_and_worn_notices(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    worn = mit.replace("free of charge ", "").replace("associated", "all the associated")
    part = " ".join(mit.split()[:8])
    rows = {r["doc_id"]: r for r in license_scan(spark.createDataFrame([(1, "x " + mit), (2, worn), (3, part), (4, "Released under the MIT License.")], "doc_id long, text string")).collect()}
    assert rows[1]["labels"] == "mit" and rows[1]["score"] == 1.0 and rows[1]["n_spans"] == 1
    assert rows[2]["labels"] == "mit" and 0.8 <= rows[2]["score"] < 1.0
    assert rows[3]["labels"] == "" and rows[3]["score"] == 0.0
    assert rows[4]["labels"] == "mit" and rows[4]["base_labels"] == ""


def test_empty_table(none):
    assert license_scan(none).collect() == []
