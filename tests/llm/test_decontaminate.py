from tidemark.llm.decontaminate import contaminated, decontaminated

ITEMS = [
    (1, "Tom has 3 apples and buys 4 more apples at the market. How many apples does Tom have after he eats 2 of them on the way home?"),
    (2, "which of the following gases makes up most of the air that we breathe every single day"),
    (3, None),
    (4, ""),
    (5, "water boils at hundred degrees"),
    (None, "the mitochondria is known as the powerhouse of the cell in most textbooks of biology"),
]


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(df, items).collect()}


def test_finds_verbatim_and_reparameterised_items(spark):
    again = ITEMS[0][1].replace("Tom", "Ann").replace("3", "17").replace("4", "5").replace("2", "9")
    broken = ITEMS[0][1].replace("Tom", "Ann", 1).replace("does Tom", "does Bob")
    rows = found(spark, [
        (10, "Some words before. " + ITEMS[0][1] + " And some after."),
        (11, "Here it comes: " + again),
        (12, "Here: " + broken),
        (13, "nothing of the kind stands in this text, though it speaks of apples and of the market"),
        (14, "*** WHICH OF THE FOLLOWING GASES!! MAKES UP MOST### of the air that we breathe every single day"),
        (15, "we know that water boils at hundred degrees up here"), (16, None), (17, ""),
        (None, ITEMS[5][1]), (None, ITEMS[5][1]),
    ])
    assert set(rows) == {(10, 1), (11, 1), (14, 2), (15, 5), (None, None)}
    assert rows[10, 1]["verbatim"] and rows[10, 1]["coverage"] == 1.0
    assert not rows[11, 1]["verbatim"] and rows[11, 1]["consistency"] == 1.0


def test_leaks_of_the_tables_and_nothing_else(spark):
    import re

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    every = [(r["item_id"], words(r["text"])) for r in items.collect()]
    want = set()
    for r in docs.collect():
        text = " " + " ".join(words(r["text"])) + " "
        want |= {(r["doc_id"], i) for i, w in every if f" {' '.join(w)} " in text}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert want and got == want
    assert decontaminated(docs, items).count() == docs.count() - len({d for d, _ in want})


def test_odd_and_empty(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contaminated(odd, items).collect() == []
    assert contaminated(none, items).collect() == []
    assert contaminated(odd, items.limit(0)).collect() == []
    assert decontaminated(odd, items).count() == odd.count()


def test_finds_plain_copies_whatever_their_capitals_and_slots(spark):
    items = [
        (1, "Der Hund und die Katze gehen mit der Frau von Berlin nach Hamburg in die Schule am Markt"),
        (2, "Ann Lee, Bob Ray, Tom Fox, 12 34 56 78"),
        (3, "x = 3 + 4 * 5 - 6"),
        (4, "Quantum chromodynamics"),
        (5, "The river that we saw in the morning was wide and cold"),
    ]
    docs = [
        (10, "so " + items[0][1].lower() + " again"), (11, "so " + items[0][1].upper() + " again"), (20, "we met " + items[1][1] + " there"), (21, items[1][1].lower()), (30, "take " + items[2][1] + " now"),
        (40, "about quantum chromodynamics again"), (41, "about quantum fields again"), (50, "of The Hague. " + items[4][1] + ". He said so"), (22, "we met Sue Kay, Jim Orr, Pat May, 99 88 77 66 there"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(rows) == {(10, 1), (11, 1), (20, 2), (21, 2), (30, 3), (40, 4), (50, 5)}
    assert all(r["verbatim"] and r["coverage"] == 1.0 and r["consistency"] == 1.0 for r in rows.values())


def test_finds_items_whose_slots_or_words_grew(spark):
    item = "The old train to Paris leaves the small station at 5 and the driver of the train says that all people on the way to Paris must pay for the whole journey before it starts"
    text = lambda city, hour: item.replace("Paris", city).replace("5", hour)
    more = text("Rome", "7").replace("leaves", "very often leaves").replace("people", "the other tall people").replace("must pay", "must as ever pay")
    docs = [(1, "so it goes. " + text("New York", "twenty five")), (2, "so it goes. " + more), (4, "we saw Bob. " + item + ". " + item)]
    pairs = [(5, "here Tom Fox has 3 apples"), (6, item)]
    rows = {(r["doc_id"], r["item_id"]): r for r in contaminated(spark.createDataFrame([*docs, (7, "so here Ann Lee Poe has 4 apples. here Bob has 9 apples.")], "doc_id long, text string"), spark.createDataFrame(pairs, "item_id long, text string")).collect()}
    assert set(rows) == {(1, 6), (2, 6), (4, 6), (7, 5)}
    assert rows[1, 6]["coverage"] == 1.0 and rows[1, 6]["consistency"] == 1.0 and not rows[1, 6]["verbatim"]
    assert rows[2, 6]["coverage"] >= 0.5 and rows[4, 6]["verbatim"]
