r"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are canonicalised: names, numbers and units become typed placeholders, the rest is lower-cased and cut into words. Windows
of five words of documents and benchmark items are hash-joined. An item is found in a document if the document has 80 per cent
of the item's windows and, where the item has placeholders, its slots are filled consistently and one to one: a value of the
item always stands for the same value of the document, and no two values of the item for the same one. Equal values mean a copy,
others a re-parameterised question. Consistency is judged for each alignment of item and document by itself, so that other places
of a document do not spoil a copy.

Names are capitalised words: of several capitals and with inner apostrophes too, but not those that begin sentences in several languages.
A sentence in which nouns are capitalised, known by its function words, which a variant shares, has no name slots. Units may be attached to
their numbers, currency signs are units, and number words are numbers. An item that consists of slots for the most part is looked up by
windows over runs: neighbouring slots of a sentence are one, and what a run stands for as a whole is its value.

Besides, windows of the plain lower-cased words are joined in the same way. They need no slots, so that a verbatim copy is found
whatever its case, what stands before it, and however few plain words it has. An item is found if either form is.

A document that has 80 per cent of an item's windows has at least one of any 20 per cent and one more of them. So the pairs of
document and item come from the rarest windows of each item alone, and a window that many documents and items share makes no pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.llm.common import fresh, materialize, table

#: Words of a window, per cent of an item's windows to be met, and the share of its slots that one mapping must explain.
WINDOW, PERCENT, CONSISTENCY = 5, 80, 0.9
#: Windows of the benchmark, and rows of other tables, that are broadcast at most; more are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_ROWS = 1_000_000, 1_000_000
NAME_SLOT, NUMBER_SLOT, UNIT_SLOT = "\u0001", "\u0002", "\u0003"
SLOTS = NAME_SLOT + NUMBER_SLOT + UNIT_SLOT
#: The forms that windows are taken from; the form is part of a window's hash.
TEMPLATE, PLAIN, RUNS = 0, 1, 2
#: Words and signs that count as units after a number, and signs that do before one.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs hours minutes seconds days weeks months years "
    "dollars euros pounds cents percent degrees meters metres kilometers kilometres miles feet inches grams kilograms liters litres mph kmh W kW V A Hz kHz MHz GHz KB MB GB TB "
    "Stunden Minuten Sekunden Tage Wochen Monate Jahre Meter Kilometer Liter Gramm Kilogramm Prozent Euro heures jours semaines mois ans mètres litres grammes kilomètres "
    "horas minutos segundos días semanas meses años metros litros gramos kilómetros % € $ £ ¥ °"
)
CURRENCIES = "$€£¥"
#: Numbers in words.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf deux trois quatre cinq sept huit neuf dix onze douze dos tres cuatro cinco seis siete ocho nueve diez once doce"
)
#: Capitalised words that are no names: they begin sentences, or are units or numbers.
NO_NAMES = (
    "A An And Are As At But By Can Consider Could Do Does Each Every Find For From Give Given Has Have He Her His How Hz I If In Is It Its Let "
    "No Not Of On One Or Our She Should Since So Some Suppose That The Their Then There These They This Those To Was We Were What When Where Which "
    "While Who Why Will With Would You Your "
    "Aber Auch Auf Aus Bei Das Dem Den Der Die Ein Eine Er Es Für Im Ist Mit Nach Nicht Sie Und Von Wann Warum Wenn Wer Wie Wieviel Wir Wo Zu Zum "
    "Avec Ce Ces Cette Combien Dans De Des Du Elle Elles En Est Et Il Ils Je La Le Les Mais Nous On Par Pour Que Quel Quelle Qui Si Sur Un Une Vous "
    "Al Con Cuál Cuántas Cuántos Cómo Del El Este Esta Los Las Para Pero Por Qué Quién Son Su Una Unos Y "
) + " ".join(w.capitalize() for w in NUMBER_WORDS.split())
#: Function words of the language that capitalises its nouns; two of them, one of the commonest, and one in eight words mark a sentence.
NOUN_CAPITALS = "der das und ein eine einen einem einer dem den ist sind mit für von vom zum zur nicht auf sich wird werden auch nach oder haben wie viele kauft hat gibt seine ihre als noch dann"
COMMONEST = ("und", "der", "den", "mit", "eine")
_EDGE_BEFORE, _EDGE_AFTER = r"(?<![\p{L}\p{M}\p{N}])", r"(?![\p{L}\p{M}\p{N}])"
#: Any other capitalised word, wherever it stands: what comes before it does not matter, so item and document agree on it.
_BY_LETTER = {w[0]: [x[1:] for x in NO_NAMES.split() if x[0] == w[0]] for w in NO_NAMES.split()}
_NO_NAME = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in _BY_LETTER.items())
NAME = rf"(?=\p{{Lu}}){_EDGE_BEFORE}(?!(?:{_NO_NAME}){_EDGE_AFTER})\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['’](?=\p{{Lu}}))++(?!\p{{N}})"
DIGITS = r"[0-9]+(?:[.,:/][0-9]+)*"
#: Numbers in digits or words; where words are at hand, those in words are told by the word instead.
NUMBER = rf"{DIGITS}|(?iu:{_EDGE_BEFORE}(?:{'|'.join(NUMBER_WORDS.split())}){_EDGE_AFTER})"
# a unit follows a digit, and no letter or digit goes on after it; a sign needs no end
_WORD_UNITS, _SIGNS = [u for u in UNITS.split() if u.isalpha()], "".join(u for u in UNITS.split() if not u.isalpha())
_AFTER_DIGIT = rf"\s?(?:(?:{'|'.join(sorted(_WORD_UNITS, key=lambda u: (-len(u), u)))}){_EDGE_AFTER}|[{_SIGNS}])"
_BEFORE_DIGIT = rf"[{CURRENCIES}](?=\s?[0-9])"
UNIT = rf"(?<=[0-9]){_AFTER_DIGIT}|{_BEFORE_DIGIT}"
_NOUNS = rf" (?:{'|'.join(NOUN_CAPITALS.split())})(?= )"
_NOT_WORD = r"[^\p{L}\p{M}\p{N}\x01-\x03]+"
#: Slots with nothing but marks and blanks between them, within a sentence.
_GAP = r"[^\p{L}\p{M}\p{N}\x01-\x03.!?\n]*"
_RUN, _SAME, _MIXED = rf"[\x01-\x03](?:{_GAP}[\x01-\x03])*", rf"([\x01-\x03])(?:{_GAP}\1)+", rf"[\x01-\x03](?:{_GAP}[\x01-\x03])+"


def _unmarked(text: Column) -> Column:
    """The text with blanks for the control characters of the placeholders; empty for a null text."""
    text = F.coalesce(text, F.lit(""))
    for mark in SLOTS:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return text


def _by_sentence(text: Column, named: Callable[[Column], Column], nameless: Callable[[Column], Column], joined: Callable[[Column], Column]) -> Column:
    """``named`` of the text, or ``joined`` of its sentences, each by ``nameless`` if it capitalises nouns and by ``named`` if not."""
    some = lambda x: reduce(Column.__or__, (F.contains(x, F.lit(f" {w} ")) for w in COMMONEST))
    dense = lambda s: some(s) & (F.greatest(F.lit(2), F.ceil(F.size(F.split(s, " ")) / 8)) <= F.regexp_count(s, F.lit(_NOUNS)))
    parts = lambda x: F.transform(F.split(x, r"(?<=[.!?\n])"), lambda s: F.when(dense(s), nameless(s)).otherwise(named(s)))
    # as a lambda's variable the text is worked out once, however often it is named
    return F.get(F.transform(F.array(text), lambda x: F.when(some(x), joined(parts(x))).otherwise(named(x))), F.lit(0))


def _marked(text: Column, number: str = NUMBER) -> Column:
    """The text with a mark, between blanks, for each slot."""
    # what all matches begin with comes first, so that most characters are passed by one look
    units = F.regexp_replace(_unmarked(text), f"(?=[0-9{CURRENCIES}])(?:([0-9]){_AFTER_DIGIT}|{_BEFORE_DIGIT})", f"$1 {UNIT_SLOT} ")
    names = _by_sentence(units, lambda t: F.regexp_replace(t, NAME, f" {NAME_SLOT} "), lambda t: t, lambda parts: F.array_join(parts, ""))
    return F.regexp_replace(names, number, f" {NUMBER_SLOT} ")


def _words(marked: Column) -> Column:
    return F.array_remove(F.split(F.lower(marked), _NOT_WORD), "")


def template_words(text: Column) -> Column:
    """The canonical words of a text; none for a null text. Control characters of the placeholders count as blanks."""
    return F.transform(_words(_marked(text, DIGITS)), lambda w: F.when(w.isin(*NUMBER_WORDS.split()), NUMBER_SLOT).otherwise(w))


def run_words(text: Column) -> Column:
    """The canonical words with each run of slots as one: the kind that all of it are, or else a unit's, which numbers with units are."""
    same = F.regexp_replace(_marked(text), _SAME, "$1")
    return _words(F.regexp_replace(same, _MIXED, f" {UNIT_SLOT} "))


def plain_words(text: Column) -> Column:
    """The lower-cased words of a text, without placeholders; none for a null text."""
    return _words(_unmarked(text))


def slot_values(text: Column) -> Column:
    """What the placeholders of a text stand for, in order."""
    found = lambda names: lambda t: F.regexp_extract_all(t, F.lit(f"{UNIT}|{NAME}|{NUMBER}" if names else f"{UNIT}|{NUMBER}"), F.lit(0))
    return F.transform(_by_sentence(_unmarked(text), found(True), found(False), F.flatten), lambda v: F.trim(v))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: str, form: int) -> Column:
    """A hash for each window of five words of a form, from the words' hashes; fewer words make one window; no words none."""
    n = F.size(hashes)
    firsts = F.slice(hashes, F.lit(1), F.greatest(n - (WINDOW - 1), F.least(n, F.lit(1))))
    return F.transform(firsts, lambda w, k: F.xxhash64(w, *(F.get(hashes, k + i) for i in range(1, WINDOW)), F.lit(form)))


def explode_windows(rows: DataFrame, forms: dict[str, int]) -> DataFrame:
    """The rows, without the columns of ``forms``, once for each window of these, with ``place`` and ``hash``.

    A column of ``forms`` has the hashes of the words in a form; windows and hashes are those of ``window_hashes``, and ``place`` counts
    a form's windows from 0. Places are exploded before windows are hashed, so that the hashing, and a join after it, run in
    generated code and no row carries the words.
    """
    names, others = list(forms), [F.col(f"`{c}`") for c in rows.columns if c not in forms]
    counts = [F.greatest(F.size(c) - (WINDOW - 1), F.least(F.size(c), F.lit(1))) for c in names]
    ends = F.array(*(reduce(Column.__add__, counts[: k + 1]) for k in range(len(names))))
    counted = rows.select(*others, *names, ends.alias("_ends"))
    counted = counted.select(*others, *names, *(F.get("_ends", F.lit(k)).alias(f"_end{k}") for k in range(len(names))))
    last = F.col(f"_end{len(names) - 1}")
    each = counted.select("*", F.explode(F.when(last > 0, F.sequence(F.lit(0), last - 1))).alias("_at"))

    def pick(value: Callable[[str, Column], Column]) -> Column:
        """``value`` of the column that the window belongs to, and of its place there."""
        places = [F.col("_at") - (F.col(f"_end{k - 1}") if k else F.lit(0)) for k in range(len(names))]
        out = value(names[-1], places[-1])
        for k in reversed(range(len(names) - 1)):
            out = F.when(F.col("_at") < F.col(f"_end{k}"), value(names[k], places[k])).otherwise(out)
        return out

    hashed = pick(lambda c, at: F.xxhash64(*(F.get(c, at + i) for i in range(WINDOW)), F.lit(forms[c])))
    return each.select(*others, pick(lambda _, at: at).alias("place"), hashed.alias("hash"))


def _solid(words: Column) -> Column:
    """Words of a window that are no placeholders."""
    return F.size(F.filter(words, lambda w: F.translate(w, SLOTS, "") != ""))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_key, item_id, form, start, hash, windows): all plain windows, and the template windows that have two words or more
    besides placeholders, or one if it is all there is. An item that keeps under half its template windows has those over runs instead.

    ``windows`` counts the item's different hashes of a form. ``benchmark`` comes from ``_items``.
    """
    def windows(form: int, words: Column) -> DataFrame:
        found = benchmark.select("item_key", "item_id", words.alias("words")).withColumn("hashes", word_hashes(F.col("words")))
        return found.select("item_key", "item_id", F.lit(form).alias("form"), "words", F.posexplode(window_hashes("hashes", form)).alias("start", "hash"))

    def telling(rows: DataFrame) -> DataFrame:
        solid = rows.where(_solid(F.slice("words", F.col("start") + 1, WINDOW)) >= F.least(F.lit(2), F.size("words")))
        # what is left of a text that is mostly placeholders says too little of it
        most = solid.groupBy("item_key").agg(F.count("*").alias("n"), F.max(F.greatest(F.size("words") - (WINDOW - 1), F.lit(1))).alias("all"))
        return solid.join(most.where(2 * F.col("n") >= F.col("all")).select("item_key"), "item_key", "left_semi")

    template = telling(windows(TEMPLATE, template_words(F.col("text"))))
    runs = telling(windows(RUNS, run_words(F.col("text")))).join(template.select("item_key").distinct(), "item_key", "left_anti")
    rows = template.unionByName(runs).unionByName(windows(PLAIN, plain_words(F.col("text")))).drop("words")
    counts = rows.groupBy("item_key", "form").agg(F.countDistinct("hash").alias("windows"))
    return rows.join(counts, ["item_key", "form"])


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_key, item_id, text): each different text of an item once; items of null id are left out."""
    return benchmark.where(F.col("item_id").isNotNull()).select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text").dropDuplicates(["item_key"])


def _slots(rows: DataFrame, key: list[str], form: int) -> DataFrame:
    """(key, at, value): the words of a text in a form that are slots, with what they stand for; a run stands for all its values."""
    marks = lambda x: F.length(x) - F.length(F.translate(x, SLOTS, ""))
    held = F.transform(F.regexp_extract_all(_marked(F.col("text")), F.lit(_RUN), F.lit(0)), marks) if form == RUNS else F.array_repeat(F.lit(1), F.size("values"))
    words = rows.select(*key, (run_words if form == RUNS else template_words)(F.col("text")).alias("words"), slot_values(F.col("text")).alias("values"), "text")
    each = words.select(*key, "values", held.alias("held"), F.posexplode("words").alias("at", "word")).where(marks(F.col("word")) > 0)
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("at")) - 1)
    first = F.aggregate(F.slice("held", F.lit(1), F.col("nth")), F.lit(0), lambda a, n: a + n) if form == RUNS else F.col("nth")
    value = F.array_join(F.slice("values", first + 1, F.get("held", F.col("nth"))), " ")
    return each.select(*key, "at", F.lower(value).alias("value"))


def _alignments(hits: DataFrame) -> DataFrame:
    """(row_key, item_key, kind, label, place, start): the hits of each alignment that has 80 per cent of the item's windows.

    A hit lies on the diagonal place - start. Alignments are single diagonals (kind 0), two rows of bands as wide as the
    item, half a band apart, and the whole document (1 to 3), each with one hit for each start, the nearest to the commonest
    diagonal, and all hits of the document together (4).
    """
    diagonal, width = F.col("place") - F.col("start"), F.col("windows") + (WINDOW - 1)
    labels = (diagonal, F.floor(diagonal / width), F.floor(diagonal / width + 0.5), F.lit(0), F.lit(0))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), label.cast("long").alias("label")) for k, label in enumerate(labels)))
    once = hits.dropDuplicates(["row_key", "item_key", "place", "start"])
    each = once.select("row_key", "item_key", "windows", "hash", "place", "start", diagonal.alias("diagonal"), F.explode(kinds).alias("a")).select("*", "a.*").drop("a")
    key = ["row_key", "item_key", "kind", "label"]
    whole = each.groupBy(*key, "windows").agg(F.countDistinct("hash").alias("matched")).where(100 * F.col("matched") >= PERCENT * F.col("windows"))
    each = each.join(whole.select(*key), key, "left_semi")
    each = each.withColumn("n", F.count("*").over(Window.partitionBy(*key, "diagonal")))
    each = each.withColumn("main", F.max(F.struct("n", (-F.col("diagonal")).alias("less"))).over(Window.partitionBy(*key)))
    nearest = Window.partitionBy(*key, "start").orderBy(F.abs(F.col("diagonal") + F.col("main.less")), "place")
    return each.withColumn("rank", F.row_number().over(nearest)).where((F.col("rank") == 1) | F.col("kind").isin(0, 4)).select(*key, "place", "start")


def _consistency(filled: DataFrame, key: list[str]) -> DataFrame:
    """(key, consistency, copied) from (key, item_value, doc_value): the share that a one-to-one map of values explains.

    The map pairs the values that are each other's most frequent partner.
    """
    uses = filled.groupBy(*key, "item_value", "doc_value").agg(F.count("*").alias("n"))
    there = F.row_number().over(Window.partitionBy(*key, "item_value").orderBy(F.desc("n"), "doc_value"))
    back = F.row_number().over(Window.partitionBy(*key, "doc_value").orderBy(F.desc("n"), "item_value"))
    mapped = uses.withColumn("there", there).withColumn("back", back)
    explained = F.sum(F.when((F.col("there") == 1) & (F.col("back") == 1), F.col("n")).otherwise(0))
    same = F.sum(F.when(F.col("item_value") == F.col("doc_value"), F.col("n")).otherwise(0))
    return mapped.groupBy(*key).agg((explained / F.sum("n")).alias("consistency"), (same == F.sum("n")).alias("copied"))


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _candidates(hits: DataFrame, known: DataFrame) -> DataFrame:
    """(row_key, item_key, form) of the pairs that may reach the coverage: those that meet one of an item's rarest windows.

    Rare is what few places of the documents have. An item of w windows, of which n are needed, is looked up by w - n + 1.
    """
    frequency = _few(hits.groupBy("hash").agg(F.count("*").alias("n")), BROADCAST_WINDOWS)
    own = known.select("item_key", "form", "hash", "windows").distinct().join(frequency, "hash", "left")
    rarest = Window.partitionBy("item_key", "form").orderBy(F.coalesce("n", F.lit(0)), "hash")
    needed = F.floor((PERCENT * F.col("windows") + 99) / 100)
    probes = own.withColumn("rank", F.row_number().over(rarest)).where(F.col("n").isNotNull() & (F.col("rank") <= F.col("windows") - needed + 1))
    return hits.join(_few(materialize(probes.select("hash", "item_key", "form"), "probes"), BROADCAST_WINDOWS), "hash").select("row_key", "item_key", "form").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_key, doc_id, item_id, matched, windows, coverage, consistency, copied), one row for each document and item text found.

    ``row_key`` is a hash of doc_id and text, so rows of null doc_id are judged as well; equal rows count once. Null and empty texts
    match nothing. A text of fewer than five words is one window, so it matches only equal ones. ``matched`` and
    ``windows`` are those of the form with the higher coverage, the template where both are equal. ``copied`` says
    whether the windows that met hold equal values. An empty table on either side gives no rows. Other columns are ignored.
    One pass over the texts, without a shuffle of their windows as long as the benchmark has at most BROADCAST_WINDOWS of them.
    """
    items = _items(benchmark)
    known = materialize(benchmark_windows(items), "benchmark")
    forms = [TEMPLATE, RUNS] if known.where(F.col("form") == RUNS).limit(1).count() else [TEMPLATE]
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    words = texts.select("row_key", "doc_id", word_hashes(template_words(F.col("text"))).alias("template"), word_hashes(plain_words(F.col("text"))).alias("plain"), *([word_hashes(run_words(F.col("text"))).alias("runs")] if RUNS in forms else []))
    hashed = explode_windows(words, {"template": TEMPLATE, **({"runs": RUNS} if RUNS in forms else {}), "plain": PLAIN})
    # a window of a document is one row here, however many items have it
    hits = materialize(hashed.join(_few(known.select("hash").distinct(), BROADCAST_WINDOWS), "hash", "left_semi"), "hits")
    asked = materialize(_candidates(hits, known), "candidates")
    own = _few(known.select("item_key", "item_id", "form", "windows", "hash").distinct(), BROADCAST_WINDOWS)
    met = asked.join(own, ["item_key", "form"]).join(hits.select("row_key", "doc_id", "hash").distinct(), ["row_key", "hash"])
    matched = met.groupBy("row_key", "doc_id", "item_key", "item_id", "form", "windows").agg(F.count("*").alias("matched"))
    found = materialize(matched.where(100 * F.col("matched") >= PERCENT * F.col("windows")), "found")

    # a plain copy is consistent, and a whole one holds the item's values whatever the slots of other places say
    either = found.where(F.col("form") == PLAIN).withColumns({"consistency": F.lit(1.0), "copied": F.when(F.col("matched") == F.col("windows"), True)})
    for form in forms:
        either = _consistent(texts, items, known, hits, found, form).unionByName(either)
    either = either.withColumn("coverage", F.col("matched") / F.col("windows"))
    best = F.max(F.struct("coverage", (-F.col("form")).alias("form"), "matched", "windows", "consistency")).alias("best")
    out = either.groupBy("row_key", "doc_id", "item_key", "item_id").agg(best, F.coalesce(F.bool_or("copied"), F.lit(True)).alias("copied"))
    return out.select("row_key", "doc_id", "item_id", "best.matched", "best.windows", "best.coverage", "best.consistency", "copied")


def _consistent(texts: DataFrame, items: DataFrame, known: DataFrame, hits: DataFrame, found: DataFrame, form: int) -> DataFrame:
    """The rows of ``found`` in a form with slots whose slots are filled consistently, with consistency and copied."""
    # slots of the windows that met: word k of the document's window stands for word k of the item's
    item_slots = _slots(items, ["item_key"], form)
    slotted = _few(item_slots.select("item_key").distinct(), BROADCAST_ROWS)
    asked = found.where(F.col("form") == form).join(slotted, "item_key", "left_semi").select("row_key", "item_key")
    keys = _few(materialize(asked.select("row_key").distinct(), "asked"), BROADCAST_ROWS)
    doc_slots = _slots(texts.join(keys, "row_key", "left_semi").dropDuplicates(["row_key"]), ["row_key"], form)
    starts = _few(known.where(F.col("form") == form).select("item_key", "windows", "start", "hash"), BROADCAST_WINDOWS)
    aligned = materialize(_alignments(asked.join(starts, "item_key").join(hits.select("row_key", "hash", "place"), ["row_key", "hash"])), "aligned")
    key = ["row_key", "item_key", "kind", "label"]
    met = aligned.select(*key, F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))).alias("k"), "place", "start")
    met = met.select(*key, (F.col("place") + F.col("k")).alias("doc_at"), (F.col("start") + F.col("k")).alias("item_at")).distinct()
    filled = met.join(item_slots.select("item_key", F.col("at").alias("item_at"), F.col("value").alias("item_value")), ["item_key", "item_at"])
    filled = filled.join(doc_slots.select("row_key", F.col("at").alias("doc_at"), F.col("value").alias("doc_value")), ["row_key", "doc_at"])
    judged = _consistency(filled, key)
    # an alignment whose windows hold no slot is consistent
    judged = aligned.select(*key).distinct().join(judged, key, "left").select("row_key", "item_key", F.coalesce("consistency", F.lit(1.0)).alias("consistency"), F.coalesce("copied", F.lit(True)).alias("copied"))
    agreed = judged.groupBy("row_key", "item_key").agg(F.max("consistency").alias("consistency"), F.bool_or("copied").alias("copied"))
    templates = found.where(F.col("form") == form).join(agreed, ["row_key", "item_key"], "left")
    return templates.withColumns({"consistency": F.coalesce("consistency", F.lit(1.0)), "copied": F.coalesce("copied", F.lit(True))}).where(F.col("consistency") >= CONSISTENCY)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, in which no benchmark item is found.

    Rows of null or empty text stay, as do rows of null doc_id that hold no item. Repeated rows stay or go together.
    """
    key = fresh(docs.columns, "row_key")[0]
    found = materialize(find_contamination(docs, benchmark).select(F.col("row_key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(_few(found, BROADCAST_ROWS), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")
