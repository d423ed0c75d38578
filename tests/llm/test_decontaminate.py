import random

from millrace.llm import decontaminate as d

VOCABULARY = [f"w{i}" for i in range(400)]


def edits_to_best_run(item, words):
    above = list(range(len(item) + 1))
    best = above[-1]
    for w in words:
        now = [0]
        for j, x in enumerate(item, 1):
            now.append(min(above[j - 1] + (x != w), above[j] + 1, now[j - 1] + 1))
        above, best = now, min(best, now[-1])
    return best


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(VOCABULARY)
        elif kind == 1:
            words.insert(at, rng.choice(VOCABULARY))
        elif len(words) > 3:
            del words[at]
    return words


def test_recall_and_no_false_positive(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(12, 60)))) for i in range(60)]
    docs = []
    for i in range(400):
        words = rng.choices(VOCABULARY, k=rng.randint(0, 200))
        if i % 2 == 0:
            item = d.fold(items[rng.randrange(60)][1])
            passage = edited(rng, [w.decode() for w in item], rng.randint(0, d.allowed(len(item))))
            at = rng.randint(0, len(words))
            words = words[:at] + passage + words[at:]
        docs.append((i, " ".join(words)))
    want = set()
    for i, text in docs:
        words = d.fold(text)
        for item_id, item in items:
            folded = d.fold(item)
            if edits_to_best_run(folded, words) <= d.allowed(len(folded)):
                want.add((i, item_id))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 200
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def test_verbatim_passages_are_all_found(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    want = {
        (x.doc_id, i.item_id)
        for x in docs.collect()
        for i in items.collect()
        if b" " + b" ".join(d.fold(i.text)) + b" " in b" " + b" ".join(d.fold(x.text)) + b" "
    }
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).where("edits = 0").collect()}
    assert got == want
    assert want


def test_edge_cases(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, ""), (3, None), (None, "a b c"), (4, "***")], "item_id long, text string")
    rows = [(1, "ONE, two three four five six!", 0), (1, "ONE, two three four five six!", 0), (2, None, 0), (3, "", 0), (None, "x one two three four five six y", 0), (4, "two three", 0), (5, "pad " * 50000 + "one two three four FIVE six", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = d.contaminated(docs, items).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.edits) for r in got) == [(-1, 1, 0), (1, 1, 0), (1, 1, 0), (5, 1, 0)]
    left = d.remove(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert d.contaminated(docs, items.limit(0)).count() == 0
    assert d.contaminated(docs.limit(0), items).count() == 0


def test_all_copies_at_the_limit_are_found_at_any_length(spark):
    """Copies with as many edits as are allowed, by item length; distances equal those by brute force."""
    rng = random.Random(23)
    for length in (5, 10, 20, 40, 60, 100, 200, 400):
        items = [(i, " ".join(rng.choices(VOCABULARY, k=length))) for i in range(12)]
        docs = []
        for i in range(48):
            words = rng.choices(VOCABULARY, k=rng.randint(0, 120))
            at = rng.randint(0, len(words))
            docs.append((i, " ".join(words[:at] + edited(rng, items[i % 12][1].split(), d.allowed(length)) + words[at:])))
        want = {}
        for i, text in docs:
            edits = edits_to_best_run(d.fold(items[i % 12][1]), d.fold(text))
            assert edits <= d.allowed(length)
            want[i, i % 12] = edits
        got = {(r.doc_id, r.item_id): r.edits for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
        if length > 5:
            assert got == want, length
        else:
            assert want.items() <= got.items()
