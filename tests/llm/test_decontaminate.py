import random
import re
from collections import Counter

from pyspark.sql import functions as F

from patchweave.llm import decontaminate as d

QUESTION = "Anna sells 12 apples and then asks Maria to carry 12 apples over 5 km to the big market hall in Paris today"


def bench(spark, items):
    return spark.createDataFrame([(i, t, "w", 1) for i, t in items], "item_id long, text string, words string, hash int")


def found(docs, benchmark):
    return {(r.doc_id, r.item_id, r.copied) for r in d.find_contamination(docs, benchmark).collect()}


def brute_words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def test_against_brute_force(spark, docs_of):
    """Texts without slots: an item is found if 80 per cent of its windows occur."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for k in range(20)]
    pairs = []
    for k in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if k % 2:
            item = items[rng.randrange(20)][1].split()
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                item[rng.randrange(len(item))] = "zzz"
            words[len(words) // 2 : len(words) // 2] = item[: rng.choice((len(item), len(item), len(item) * 3 // 4))]
        pairs.append((k, rng.choice((" ", ", ", "\n", " - ")).join(words).upper() if k % 7 == 0 else " ".join(words)))
    windows = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    want = {(i, j) for i, t in pairs for j, q in items if len(windows(brute_words(t)) & windows(brute_words(q))) >= 0.8 * len(windows(brute_words(q)))}
    assert {(i, j) for i, j, _ in found(docs_of(pairs), bench(spark, items))} == want and len(want) > 20


def test_reparameterised_questions(spark, docs_of):
    same = QUESTION.replace("12", "17").replace("Maria", "Berta").replace("5 km", "9 mi").replace("Paris", "London")
    mixed = QUESTION.replace("12", "17", 1).replace("12", "99")
    moved = "An intro. " + same + ". And more follows here"
    docs = docs_of([(1, QUESTION), (2, same), (3, mixed), (4, moved), (5, "Anna sells apples"), (6, "quite another text about the big market hall")])
    assert found(docs, bench(spark, [(9, QUESTION)])) == {(1, 9, True), (2, 9, False), (4, 9, False)}


def template(text):
    """(words, values): words with a mark for each slot, from a text of single words and blanks; values of the slots by place."""
    words, values = [], {}
    for word in text.split():
        slot = "#" if word.isdigit() else "@" if word[0].isupper() and word not in d.NO_NAMES.split() else "km" if word in ("km", "mi") and words and words[-1] == "#" else None
        if slot:
            values[len(words)] = word.lower()
        words.append(slot or word.lower())
    return words, values


def consistent(doc, item):
    """Whether one alignment of the texts meets 80 per cent of the item's windows, and a one-to-one map explains 90 of its slots."""
    (dw, dv), (iw, iv) = template(doc), template(item)
    solid = lambda w: sum(x not in ("#", "@", "km") for x in w) >= 2
    windows = {k: tuple(iw[k : k + 5]) for k in range(len(iw) - 4) if solid(iw[k : k + 5])}
    for shift in range(-len(iw), len(dw)):
        met = [k for k, w in windows.items() if 0 <= k + shift and tuple(dw[k + shift : k + shift + 5]) == w]
        if 100 * len({windows[k] for k in met}) < 80 * len(set(windows.values())):
            continue
        pairs = {(j, iv[j], dv[j + shift]) for k in met for j in range(k, k + 5) if j in iv}
        uses = Counter((a, b) for _, a, b in pairs)
        best = lambda own, k: min((-n, pair[1 - k]) for pair, n in uses.items() if pair[k] == own)[1]
        if sum(n for (a, b), n in uses.items() if best(a, 0) == b and best(b, 1) == a) >= 0.9 * len(pairs):
            return True
    return False


def test_slotted_texts_against_brute_force(spark, docs_of):
    """Fillings that are consistent and one to one, that use a value twice, and that vary what the item repeats."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    names = [f"{a}{b}" for a in ("Al", "Be", "Co", "Du", "Eg") for b in ("ra", "so", "ti", "vu")]
    items, pairs = [], []
    for k in range(12):
        shape = [rng.choice(["n", "m", "p", "q", *["w"] * 12]) for _ in range(rng.randint(18, 30))]
        words = [rng.choice(vocabulary) for _ in shape]
        filled = lambda f, s=shape, w=words: " ".join(f.get(x, y) for x, y in zip(s, w, strict=True))
        item = {"n": "31", "m": "47", "p": names[0], "q": names[1]}
        items.append((k, filled(item)))
        for j, filling in enumerate(({"n": "5", "m": "8", "p": names[4], "q": names[7]}, {"n": "5", "m": "5", "p": names[4], "q": names[7]}, {"n": "5", "m": "8", "p": names[4], "q": names[4]}, item)):
            filler = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 20)))
            pairs.append((10 * k + j, f"{filler()} {filled(filling)} {filler()}"))
        uneven = " ".join(str(n) if x == "n" else y for n, (x, y) in enumerate(zip(shape, filled(item).split(), strict=True)))
        pairs.append((10 * k + 4, uneven))
    plain = lambda text: {tuple(text.lower().split()[k : k + 5]) for k in range(len(text.split()) - 4)}
    want = {(i, j) for i, t in pairs for j, q in items if consistent(t, q) or 100 * len(plain(t) & plain(q)) >= 80 * len(plain(q))}
    assert {(i, j) for i, j, _ in found(docs_of(pairs), bench(spark, items))} == want
    assert 24 <= len(want) < 50 and len({i % 10 for i, _ in want}) > 2


def test_one_to_one(spark, docs_of):
    item = "a farmer has 10 sheep in the first field and buys 25 goats for the second field of the old farm"
    docs = docs_of([(1, item.replace("10", "7").replace("25", "7")), (2, item.replace("10", "7").replace("25", "9"))])
    assert found(docs, bench(spark, [(5, item)])) == {(2, 5, False)}


def test_copy_and_variant_in_one_text(spark, docs_of):
    item = "Maria has 12 apples and gives 5 to the boy next door. Maria then buys 12 pears at the market. How many are left"
    vary = lambda name, a, b: item.replace("Maria", name).replace("12", a).replace("5", b)
    docs = docs_of([(1, f"{item}? {vary('Jo', '30', '4')}"), (2, f"{vary('Jo', '30', '4')}. {vary('Zoe', '8', '2')}"), (3, vary("Zoe", "8", "8")), (4, item)])
    assert found(docs, bench(spark, [(1, item)])) == {(1, 1, True), (2, 1, False), (4, 1, True)}


def test_a_common_window_makes_no_pairs(spark, docs_of):
    """Every document and every item holds the same five words; only true copies become candidates."""
    rng, common = random.Random(4), "which of these is right"
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "mnrst"]
    tail = lambda: " ".join(rng.choices(words, k=20))
    items = [(k, f"{tail()} {common}") for k in range(40)]
    docs = docs_of([(k, f"{common} {tail()} {common}") for k in range(200)] + [(1000 + k, t) for k, t in items])
    benchmark = d._items(bench(spark, items))
    known = d.benchmark_windows(benchmark)
    words = docs.select(F.col("doc_id").alias("row_key"), d.word_hashes(d.template_words(F.col("text"))).alias("t"), d.word_hashes(d.plain_words(F.col("text"))).alias("p"))
    windows = words.select("row_key", F.posexplode(F.concat(d.window_hashes("t", 0), d.window_hashes("p", 1))).alias("place", "hash"))
    hits = windows.join(known.select("hash").distinct(), "hash", "left_semi")
    assert d._candidates(hits, known).count() == 2 * 40
    assert found(docs, bench(spark, items)) == {(1000 + k, k, True) for k in range(40)}


def test_edge_cases(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, " .,! "), (None, QUESTION), (4, QUESTION), (4, QUESTION), (5, "two words"), (6, "more than two words here"), (7, "filler " * 60_000 + QUESTION), (8, "\u0001 \u0002 \u0003"), (9, "12 13 14 15 16 17")])
    items = bench(spark, [(1, QUESTION), (1, QUESTION), (2, "Two words"), (3, None), (4, ""), (None, QUESTION), (5, "1 2 3 4 5 6")])
    assert {(i, j) for i, j, _ in found(docs, items)} == {(None, 1), (4, 1), (7, 1), (5, 2)}
    assert found(docs.limit(0), items) == set() and found(docs, items.limit(0)) == set()
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 8, 9]
    assert d.drop_contaminated(docs, items.limit(0)).count() == 11


def test_each_place_is_judged_by_itself(spark, docs_of):
    """A worksheet: other variants and single windows of an item in a document do not hide a copy of it."""
    vary = lambda a, b, c, d: QUESTION.replace("12", a).replace("Maria", b).replace("5 km", c).replace("Paris", d)
    one, two, three = vary("17", "Berta", "9 mi", "London"), vary("31", "Clara", "7 ft", "Madrid"), vary("44", "Dora", "8 yd", "Vienna")
    mixed = one.replace("17", "99", 1)
    scraps = " or ".join(f"and then asks {n} to carry {k} apples over {k + 1} km to" for k, n in enumerate(("Emil", "Franz", "Georg", "Hanna") * 3))
    longer = " and then all of them go home by the late train of the evening"
    edited = (one + longer).replace("over 9 mi", "slowly over 9 mi")
    docs = docs_of([(1, f"{QUESTION}. Next: {one}"), (2, f"{one}. {two} {three}"), (3, f"{mixed}. {scraps}"), (4, f"{scraps}. {one}. {scraps}"), (5, f"{scraps}. {QUESTION}"), (6, f"{edited}. And so on. {scraps}"), (7, mixed)])
    assert found(docs, bench(spark, [(9, QUESTION), (8, QUESTION + longer)])) == {(1, 9, True), (2, 9, False), (4, 9, False), (5, 9, True), (6, 8, False)}


def test_slots_and_values_agree(spark, docs_of):
    texts = ["10 m2", "5 km2 and 7 cm3, 10 h30", "3 kg", "4 km 5 m 6 s", "10 m2 3 m Paris, Rome 5 kmh", "1.5 l2 x 2 l", "9 kW\u00b2 8 W", "a 7 m\u0001 b", QUESTION]
    slots, values = d.template_words(F.col("text")), d.slot_values(F.col("text"))
    marks = F.aggregate(slots, F.lit(0), lambda n, w: n + F.length(w) - F.length(F.translate(w, d.SLOTS, "")))
    rows = docs_of(list(enumerate(texts))).select("text", marks.alias("marks"), F.size(values).alias("values")).collect()
    assert [(r.text, r.marks) for r in rows] == [(r.text, r["values"]) for r in rows]
    same = QUESTION.replace("12", "17")
    assert found(docs_of([(1, f"On 10 m2 and 5 km2. {QUESTION}"), (2, f"On 10 m2. {same}")]), bench(spark, [(9, QUESTION)])) == {(1, 9, True), (2, 9, False)}


def test_verbatim_copies_in_plain_words(spark, docs_of):
    """Copies whose names differ by case or by what stands before them, and items all of slots."""
    capital = "What is the capital city of France"
    docs = docs_of([(1, f"please tell me {capital} today"), (2, f"Now {QUESTION.upper()}, he said"), (3, QUESTION.lower()), (4, "1 2 3 4 5 6"), (5, "12 13 14 15 16 17"), (6, "so 1 2 3 4 5 6 7"), (7, "7"), (8, "8"), (9, "please tell me what is the capital")])
    items = bench(spark, [(1, capital), (2, QUESTION), (3, "1 2 3 4 5 6"), (4, "7")])
    assert found(docs, items) == {(1, 1, True), (2, 2, True), (3, 2, True), (4, 3, True), (6, 3, True), (7, 4, True)}
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, items).collect()) == [5, 8, 9]


def test_joined_instead_of_broadcast(spark, docs_of, monkeypatch):
    docs, items = docs_of([(1, QUESTION), (2, "clean text of a few words")]), bench(spark, [(9, QUESTION)])
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert found(docs, items) == {(1, 9, True)}
    assert [r.doc_id for r in d.drop_contaminated(docs, items).collect()] == [2]


def test_plan_is_native(spark, docs_of):
    plan = d.find_contamination(docs_of([(1, QUESTION)]), bench(spark, [(9, QUESTION)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


GERMAN = "Der Bauer hat 12 Schafe und kauft 7 Ziegen für den neuen Hof in der Stadt am Montag mit dem alten Nachbarn."
UNRELATED = "Der Lehrer hat 30 Hefte und kauft 9 Stifte für den neuen Kurs in der Schule am Freitag mit dem alten Direktor."
NUMBERS = "The values are 3, 5, 7, 9, 11 and 13. Please compute the mean of 3, 5, 7, 9, 11 and 13."


def test_nouns_are_no_names(spark, docs_of):
    """A sentence of the same build with other nouns is another sentence; with other numbers it is the question again."""
    docs = docs_of([(1, UNRELATED), (2, GERMAN.replace("12", "40").replace("7", "3")), (3, f"{QUESTION.replace('Maria', 'Berta')}. {UNRELATED}"), (4, GERMAN)])
    assert found(docs, bench(spark, [(1, GERMAN), (2, QUESTION)])) == {(2, 1, False), (3, 2, False), (4, 1, True)}


def test_every_kind_of_slot(spark, docs_of):
    item = "McDonald asks NASA to send O'Neil 90km past the old station for $90 within 3h or twelve days, says McDonald at 50% off"
    swaps = {"McDonald": "MacLeod", "NASA": "ESO", "O'Neil": "D'Arcy", "90km": "75 mi", "$90": "45 euros", "3h": "8 min", "twelve": "seven", "50%": "20 percent"}
    docs = [(k, item.replace(a, b)) for k, (a, b) in enumerate(swaps.items())]
    every = item
    for a, b in swaps.items():
        every = every.replace(a, b)
    # currency before and behind a number part the words otherwise, so that pair is varied in kind
    docs += [(20, every.replace("45 euros", "€45")), (21, item.replace("says McDonald", "says MacLeod")), (22, item.replace("station", "harbour").replace("send", "lend").replace("days", "mules"))]
    got = found(docs_of(docs), bench(spark, [(1, item)]))
    assert {i for i, _, _ in got} >= {0, 1, 2, 3, 5, 6, 7, 20} and 21 not in {i for i, j, c in got if not c and i == 22} and 22 not in {i for i, _, _ in got}


def test_items_that_are_mostly_numbers(spark, docs_of):
    other = NUMBERS.replace("3, 5, 7, 9, 11 and 13", "4, 8, 15, 16, 23 and 42")
    uneven = other.replace("4, 8, 15, 16, 23 and 42", "1, 2, 3, 4, 5 and 6", 1)
    docs = docs_of([(1, other), (2, f"A sheet. {other} And {other}"), (3, uneven), (4, NUMBERS), (5, "The values are 1, 2 and 3. Please stop."), (6, QUESTION), (7, other.replace("values", "weights").replace("mean", "sum").replace("Please", "Now"))])
    assert found(docs, bench(spark, [(1, NUMBERS), (2, QUESTION)])) == {(1, 1, False), (2, 1, False), (4, 1, True), (6, 2, True)}


def test_runs_and_their_values(docs_of):
    texts = ["a 3, 4 b", "Anna 3 km, Bob 5 km! Eve", "x $5 and 7%. 8", "", "no slots", "1 2\n3"]
    rows = docs_of(list(enumerate(texts)))
    got = {(r.doc_id, r.at, r.value) for r in d._slots(rows, ["doc_id"], d.RUNS).collect()}
    assert got == {(0, 1, "3 4"), (1, 0, "anna 3 km bob 5 km"), (1, 1, "eve"), (2, 1, "$ 5"), (2, 3, "7 %"), (2, 4, "8"), (5, 0, "1 2"), (5, 1, "3")}
