import re

from pyspark.sql import functions as F

from tidemark.llm.pseudonyms import PATTERNS, check_digit, pseudonymised

TEXTS = [
    (1, "card 4532 0151 1283 0366, again 4532015112830366; wrong 4952935900253053"), (2, "call +1 (017) 555-7713 or 212-555-0101"), (3, "from 129.38.82.176 and 256.1.1.1 and v1.2.3.4.5"),
    (4, "born 2024-02-29, seen 31.12.1999 and 01/01/2000, never 2024-02-31 or 30.02.2001, far 2500-01-01"), (5, "und.34@mail7.example.com###"), (6, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
    (7, None), (8, ""), (9, "no secrets here, 12345678 and 1,234,567,890.50"), (10, "4532015112830366"), (11, "4532015112830366"), (11, "4532015112830366"), (None, "99.99.99.99"),
]


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def shape(text):
    return re.sub("[0-9]", "9", text)


def test_formats_links_and_round_trip(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_ip", F.lit("clash"))
    out = pseudonymised(docs, "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    first = re.findall(r"\d[\d ]+\d", rows[1]["text"])
    assert all(luhn(re.sub(" ", "", x)) for x in first[:2]) and not luhn(first[2])
    assert re.sub(" ", "", first[0]) == first[1] == rows[10]["text"] == rows[11]["text"] != "4532015112830366"
    assert shape(rows[1]["text"]) == shape(TEXTS[0][1]) and shape(rows[2]["text"]) == shape(TEXTS[1][1]) and rows[2]["text"].startswith("call +1 (")
    ip = re.search(r"from (\S+) and 256.1.1.1 and v1.2.3.4.5$", rows[3]["text"])[1]
    assert all(0 <= int(x) <= 255 for x in ip.split(".")) and ip != "129.38.82.176"
    assert rows[4]["text"].endswith("never 2024-02-31 or 30.02.2001, far 2500-01-01") and shape(rows[4]["text"]) == shape(TEXTS[3][1]) and "1999" not in rows[4]["text"]
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com###", rows[5]["text"]) and "mail7" not in rows[5]["text"]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', rows[6]["text"]) and "24be64" not in rows[6]["text"]
    assert rows[7]["text"] is None and rows[8]["text"] == "" and rows[9]["text"] == TEXTS[8][1]
    assert rows[3]["n_ip"] == 1 and rows[7]["n_ip"] == 0 and rows[1]["n_number"] == 3
    back = {r["doc_id"]: r["text"] for r in pseudonymised(out, "k", undo=True).collect()}
    assert all(back[i] == t for i, t in TEXTS if i not in (5, 6))
    assert {r["doc_id"]: r["text"] for r in pseudonymised(docs, "another").collect()}[10] != rows[10]["text"]


def test_permutations_are_one_to_one(spark):
    docs = spark.range(3_000).select("id", F.concat(F.lit("10."), F.floor(F.col("id") / 256).cast("string"), F.lit(".7."), (F.col("id") % 256).cast("string")).alias("text"))
    assert pseudonymised(docs, "k").select("text").distinct().count() == 3_000
    days = spark.range(3_000).select("id", F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pseudonymised(days, "k").select("text").distinct().count() == 3_000


def test_check_digit(spark):
    rows = spark.range(200).select(F.format_string("%015d", F.col("id") * 7_654_321).alias("p")).select("p", check_digit(F.col("p")).alias("c")).collect()
    assert all(luhn(r["p"] + str(r["c"])) for r in rows)


def test_all_values_of_the_tables_go_and_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = pseudonymised(docs, "k")
    both = docs.select("doc_id", F.col("text").alias("before")).join(out, "doc_id")
    numbers = r"(?<![\p{L}\p{N}])\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}"
    held = both.select(F.explode(F.regexp_extract_all("before", F.lit(numbers), F.lit(0))).alias("v"), "text")
    assert held.count() > 10 and held.where(F.col("text").contains(F.col("v"))).isEmpty()
    plain = both.where(" + ".join(f"n_{k}" for k in PATTERNS) + " = 0")
    assert plain.where("text <> before").isEmpty()
    undone = pseudonymised(out.where("n_email + n_secret = 0"), "k", undo=True)
    assert undone.join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").where("text <> before").isEmpty()


def test_odd_and_empty(odd, none):
    assert pseudonymised(odd, "k").count() == odd.count()
    assert pseudonymised(none, "k").collect() == []


def test_international_formats_change_within_their_format_and_come_back(spark):
    values = [
        "+14155550100", "+442079460958", "+44 20 7946 0958", "+49 30 123456", "+33 (0)1 23 45 67 89", "+4930123456", "3782 822463 10005", "3782-822463-10005", "123-45-6789", "899-99-9999", "667-01-0001",
        "GB29NWBK60161331926819", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "DE88370400440532013000", "05/31/2024", "2024/05/31", "12/13/1999",
    ]
    docs = spark.createDataFrame([(i, f"see {v}, then") for i, v in enumerate(values)], "doc_id int, text string")
    out = pseudonymised(docs, "k")
    rows = {r["doc_id"]: r["text"][4:-6] for r in out.collect()}
    for i, v in enumerate(values):
        assert rows[i] != v and shape(rows[i]) == shape(v), (v, rows[i])
    assert all(luhn(re.sub("[ -]", "", rows[i])) for i in (6, 7)) and rows[0].startswith("+1") and rows[1].startswith("+44")
    assert re.sub(" ", "", rows[1]) == re.sub(" ", "", rows[2]) and re.sub(" ", "", rows[13]) == rows[12]
    mod = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97
    assert all(mod(rows[i].replace(" ", "")) == 1 for i in (11, 12, 13, 14)) and mod(rows[15]) != 1
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", rows[i]) for i in (8, 9, 10))
    assert all(int(rows[i][3:5]) > 12 >= int(rows[i][:2]) for i in (16, 18))
    assert {r["doc_id"]: r["text"][4:-6] for r in pseudonymised(out, "k", undo=True).collect()} == dict(enumerate(values))
    month_first = spark.range(2_000).select(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12").select(F.date_format("d", "MM/dd/yyyy").alias("text"))
    assert pseudonymised(month_first, "k").select("text").distinct().count() == month_first.count()
