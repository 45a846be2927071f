import math
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.fertility import VOCABULARIES, Lexicon, fertility_filter, measure


def plain(text, lexicon):
    words = (text or "").encode().split()
    texts = [w.decode() for w in words]
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        again += bool(line.encode().split()) and line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    cut = lambda t: [t[i : i + 512] for i in range(0, len(t), 512)]
    tokens = [x for t in texts for i, p in enumerate(cut(t)) for x in lexicon.bytes_bpe.encode_ordinary((" " if i == 0 else "") + p)]
    pieces = [x for t in texts for p in cut(t) for x in lexicon.pieces.encode(p)]
    counts, n = Counter(tokens), len(tokens)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    return (len(words), sum(map(len, texts)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered), n), (sum(map(len, texts)) / max(n, 1), sum(lexicon.pieces.is_byte(p) for p in pieces) / max(len(pieces), 1), entropy)


def test_measures_equal_a_plain_count(spark, odd):
    repeated = spark.createDataFrame([(30, "a b c d e f g h i " * 3 + "\nq\nq\n \n \nq"), (31, "one line\none line\n" * 4), (32, "€  \x85 \xa0b 中文字 #$%")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(repeated).withColumn("lang", F.lit("en"))
    lexicon = Lexicon(VOCABULARIES)
    rows = measure(docs).collect()
    whole = sorted(repr((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_tokens"])) for r in rows)
    want = [plain(r["text"], lexicon) for r in docs.collect()]
    assert whole == sorted(repr(w[0]) for w in want)
    for got, exact in zip(sorted((r["chars_per_token"], r["byte_share"], r["token_entropy"]) for r in rows), sorted(w[1] for w in want), strict=True):
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, exact, strict=True))


def test_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    rows = fertility_filter(docs)
    assert rows.where(F.col("base_failed") != ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))).isEmpty()
    assert rows.where("kept AND base_failed").isEmpty()
    good = rows.join(labels, "doc_id").where("NOT base_failed")
    assert good.where("kept").count() >= 0.99 * good.count()
    # Text of no language is cut into far more tokens than the band of its neighbours allows.
    noise = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(" ".join(f"q{i}x{i * 7 % 13}z" for i in range(60))).alias("text"), F.lit("en").alias("lang"), "source", "n_chars")
    judged = fertility_filter(docs.unionByName(noise)).where("doc_id = -1").first()
    assert not judged["kept"] and "chars_per_token" in judged["outside"]


def test_odd_and_empty(odd, none):
    assert fertility_filter(odd).count() == odd.count()
    assert fertility_filter(none).collect() == []


def test_a_rare_language_is_not_judged_by_the_bands_of_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    syllables = ["አማ", "ርኛ", "ሰላ", "ም", "ነው", "ቤት", "ውሃ", "ልጅ", "ቀን", "ሌሊት", "ፀሐይ", "ጨረቃ", "መን", "ገድ", "ሀገር", "ሰው"]
    texts = [(-1 - i, " ".join(syllables[(7 * i + 3 * j + j * j // 5) % 16] + syllables[(i + 5 * j) % 16] for j in range(40)), "am") for i in range(20)]
    rare = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    rows = fertility_filter(docs.unionByName(rare)).where("doc_id < 0").collect()
    assert len(rows) == 20 and {r["band"] for r in rows} == {"am"}
    assert all(r["outside"] == "" for r in rows)
