"""Operator 7: benchmark leaks by template windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.plans.scratch import written

#: Words that are units behind a number.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur gbp degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons hz kb mb gb tb"
).split()

#: So many distinct windows of a benchmark, of eight bytes each, or ids of documents that may leak, are broadcast; more are shuffled.
_BROADCAST_KEYS = 2_000_000


def _parted(text: Column) -> Column:
    """A text with numbers parted from the letters that follow them."""
    return F.when(text.rlike(r"\p{N}"), F.regexp_replace(text, r"(\p{N})(?=\p{L})", "$1 ")).otherwise(text)


def _template(parted: Column) -> Column:
    """Its words as templates: names (capitalised within a sentence), numbers, and units behind them, as placeholders, the rest in lower case without punctuation."""
    named = F.lower(F.regexp_replace(parted, r"\p{Lu}(?<=[^.!?\s][ \t]\p{Lu})\p{Ll}+", "<name>"))
    numbered = F.regexp_replace(named, r"\p{N}+(?:[.,:]\p{N}+)*", "<num>")
    typed = F.when(named.rlike(r"\p{N}"), F.regexp_replace(numbered, rf"<num>(\s+)(?:{'|'.join(UNITS)})(?![^\s\p{{P}}\p{{S}}])", "<num>$1<unit>")).otherwise(named)
    return _tokens(F.regexp_replace(typed, r"[^\p{L}\p{N}\s<>]+|<(?!(?:name|num|unit)>)|>(?<!<name>|<num>|<unit>)", ""))


def _values(parted: Column) -> Column:
    """The words that the templates stand for, one for one."""
    return _tokens(F.regexp_replace(parted, r"[^\p{L}\p{N}\s]+", ""))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _windows(hashes: Column, size: int) -> Column:
    """Array of (first word, key, hash of the word behind it) of every window of ``size`` words."""
    starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(0), F.size(hashes) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), *[F.get(hashes, i + n) for n in range(size)]).alias("key"), F.get(hashes, i + size).alias("next")))


def _hashed(template: Column) -> Column:
    return F.transform(template, lambda w: F.xxhash64(w))


def window_size(words: Column, similarity: float) -> Column:
    """How many words on end an item of ``words`` words surely keeps where ``similarity`` of them are in place: those between evenly spread changes."""
    return F.floor(words / (F.floor(words * F.lit(1 - similarity) + F.lit(1e-9)) + 1)).cast("int")


#: Words of the windows that are looked up, where an item's own windows aren't shorter.
SHORT = 3


def windows_kept(words: Column, size: Column, similarity: float) -> Column:
    """How many of an item's windows of ``SHORT`` words a leak has at least, of ``words`` and with ``window_size`` ``size``.

    A word that isn't in place takes ``SHORT`` windows away, and so each border between two parts takes two; but each part has a window of ``size``
    words, and thus ``size - 2`` short ones. The number of parts that leaves the fewest is where both bounds meet.
    """
    changed = F.floor(words * F.lit(1 - similarity) + F.lit(1e-9))
    return F.when(size >= SHORT, F.greatest(F.lit(1), F.ceil((words - SHORT * changed) * (size - SHORT + 1) / size - F.lit(1e-9)))).otherwise(1).cast("int")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    similarity: float = 0.8, consistency: float = 0.8,
) -> DataFrame:
    """``(doc_id, item_id, start_word, item_words, matched_words, similarity, slots, changed_slots, consistency)`` of every leak.

    Every window of three template words (fewer for the shortest items) of every whole document is looked up among all windows of the items, and
    what is met is counted by item and place before anything else of it is looked at: a place with fewer windows than a leak must have
    (``windows_kept``) is left, so that stock phrases make counts and no alignments. How long
    an item's own windows are follows from its length (three or four words at 0.8, or the whole of the shortest items), so that
    every place which has ``similarity`` of the item's words where the item has them shares a window with it: no
    such leak is missed. Where words are put in or left out, the parts between that have a window's words are found,
    and count together if they lie within a quarter of the item. Item and document are aligned as the windows
    say: a leak has ``similarity`` of the item's templates in place, and its slots (numbers, names, units) must be
    changed alike wherever the item repeats a value, in ``consistency`` of them; values that are unchanged count as changed
    alike. Both are asked of each occurrence by itself, and of each of its alignments; one that passes makes the leak.

    Null or wordless texts and items leak nothing; rows with a null id aren't reported; repeated rows give
    one row a pair; of an item id that has several texts each is looked for, and the one with most words in place gives the row; very long texts are looked up whole; of equal alignments the earliest gives ``start_word``; an empty table
    gives an empty one; extra columns are left out. The items' keys are broadcast up to a checked number and
    shuffled beyond it; candidates are always shuffled, and an occurrence has no more alignments than its item has words.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), _parted(F.col(item_text)).alias("parted")).where("parted is not null and item_id is not null")
    items = items.distinct().select("item_id", _template(F.col("parted")).alias("item_template"), _values(F.col("parted")).alias("item_values")).where(F.size("item_template") > 0)
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")  # an id's texts are items of their own up to the last step
    hashed = items.select("item", F.size("item_template").alias("item_words"), _hashed(F.col("item_template")).alias("h"))
    hashed = hashed.withColumn("whole", window_size(F.col("item_words"), similarity)).withColumn("size", F.least(F.lit(SHORT), "whole"))
    sizes = sorted(r[0] for r in hashed.select("size").distinct().collect())  # three at most
    sought = None
    for size in sizes:
        part = hashed.where(F.col("size") == size).select("item", "item_words", "whole", F.explode(_windows(F.col("h"), size)).alias("w"))
        sought = part if sought is None else sought.unionByName(part)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    if sought is None:
        return rows.select("doc_id", F.lit(0).alias("start_word")).limit(0).crossJoin(items.limit(0)).selectExpr(
            "doc_id", "item_id", "start_word", "0 AS item_words", "0 AS matched_words", "0D AS similarity", "0 AS slots", "0 AS changed_slots", "0D AS consistency")
    asked = F.when(F.col("whole") > SHORT, F.coalesce("w.next", F.lit(0)))  # of an item with longer windows the next word must be the same, too, where an alignment is to be
    sought = written(sought.select("item", "item_words", F.col("w.at").alias("item_at"), F.col("w.key").alias("key"), asked.alias("asked")), "windows")
    keys = written(sought.select("key").distinct(), "keys")

    ranked = rows.select("doc_id", _hashed(_template(_parted(F.col("text")))).alias("h"))
    seen = ranked.select("doc_id", F.inline(F.concat(*[_windows(F.col("h"), size) for size in sizes])))
    if keys.count() <= _BROADCAST_KEYS:
        seen = seen.join(F.broadcast(keys), "key", "left_semi")
    # Alignments of one occurrence lie within a quarter of the item; they are dealt into two rows of places, half of each apart, so some place has them all.
    half = F.ceil(F.col("item_words") / 4).cast("int")
    whole = F.col("asked").isNull() | F.col("asked").eqNullSafe(F.col("next"))
    hits = seen.join(sought, "key").select("doc_id", "item", "item_words", (F.col("at") - F.col("item_at")).alias("shift"), whole.alias("whole"))
    placed = hits.withColumn("half", half).withColumn("row", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("occurrence", F.floor((F.col("shift") + F.col("row") * F.col("half")) / (2 * F.col("half"))).cast("int"))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(shift, F.lit(64)))
    counted = placed.groupBy("doc_id", "item", "item_words", "row", "occurrence").agg(F.count("*").alias("n"), F.bit_or(F.when(F.col("whole"), bit(F.col("shift"))).otherwise(F.lit(0).cast("long"))).alias("shifts"))
    counted = counted.where(F.col("n") >= windows_kept(F.col("item_words"), window_size(F.col("item_words"), similarity), similarity))
    begin = 2 * half * F.col("occurrence") - half * F.col("row")
    near = F.filter(F.sequence(begin, begin + 2 * half - 1), lambda x: F.col("shifts").bitwiseAND(bit(x)) != 0)
    met = written(counted.select("doc_id", "item", "item_words", F.explode(near).alias("shift")).distinct(), "met")

    named = written(met.select("doc_id").distinct(), "named")
    leaking = rows.join(F.broadcast(named) if named.count() <= _BROADCAST_KEYS else named, "doc_id", "left_semi").distinct().withColumn("parted", _parted(F.col("text")))
    templates = written(leaking.select("doc_id", _template(F.col("parted")).alias("doc_template"), _values(F.col("parted")).alias("doc_values")), "templates")
    begin = F.greatest(F.lit(0), "shift")
    place = lambda c: F.slice(c, begin + 1, F.greatest(F.lit(0), F.col("shift") + F.col("item_words") - begin)).alias(c)
    aligned = met.join(templates, "doc_id").select("doc_id", "item", "item_words", "shift", (F.col("shift") - begin).alias("lead"), place("doc_template"), place("doc_values"))
    aligned = written(aligned.join(items, "item"), "aligned")
    there = F.filter(F.sequence(F.lit(0), F.col("item_words") - 1), lambda i: F.get("item_template", i) == F.get("doc_template", F.col("lead") + i))
    slots = F.transform(
        F.filter("there", lambda i: F.get("item_template", i).isin("<name>", "<num>", "<unit>")),
        lambda i: F.struct(i.alias("i"), F.get("item_values", i).alias("was"), F.get("doc_values", F.col("lead") + i).alias("now")),
    )
    aligned = aligned.withColumn("there", there).select("doc_id", "item", "item_id", "item_words", "shift", "there", slots.alias("slots"))
    size = window_size(F.col("item_words"), similarity)
    aligned = aligned.where(F.exists("there", lambda i: F.forall(F.sequence(F.lit(0), size - 1), lambda n: F.array_contains("there", i + n))))
    dealt = aligned.withColumn("half", half).withColumn("row", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("occurrence", F.floor((F.col("shift") + F.col("row") * F.col("half")) / (2 * F.col("half"))))
    part = F.struct((-F.size("there")).alias("less"), "shift", "there", "slots")
    grouped = dealt.groupBy("doc_id", "item", "item_id", "row", "occurrence").agg(F.first("item_words").alias("item_words"), F.array_sort(F.collect_set(part)).alias("parts"))
    # A word of the item counts where the fullest alignment has it.
    taken = lambda a, x: F.array_union(a["there"], x["there"])
    added = lambda a, x: F.concat(a["slots"], F.filter(x["slots"], lambda s: ~F.array_contains(a["there"], s["i"])))
    whole_one = F.aggregate("parts", F.get("parts", 0), lambda a, x: F.struct(a["less"].alias("less"), a["shift"].alias("shift"), taken(a, x).alias("there"), added(a, x).alias("slots")))
    each = grouped.select("doc_id", "item_id", "item_words", F.explode(F.concat("parts", F.array(whole_one))).alias("p"))
    each = each.where(F.size("p.there") >= F.lit(similarity) * F.col("item_words"))
    pairs = F.array_distinct(F.transform("p.slots", lambda s: F.struct(s["was"].alias("was"), s["now"].alias("now"))))
    each = each.select("doc_id", "item_id", "item_words", F.col("p.shift").alias("shift"), F.size("p.there").alias("matched_words"), pairs.alias("slots"))
    values = F.size(F.array_distinct(F.transform("slots", lambda s: s["was"])))
    found = each.select(
        "doc_id", "item_id", "shift", "item_words", "matched_words",
        (F.col("matched_words") / F.col("item_words")).alias("similarity"), F.size("slots").alias("slots"),
        F.size(F.filter("slots", lambda s: s["was"] != s["now"])).alias("changed_slots"),
        F.when(F.size("slots") > 0, values / F.size("slots")).otherwise(1.0).alias("consistency"),
    ).where(F.col("consistency") >= consistency)
    names = ("item_words", "matched_words", "similarity", "slots", "changed_slots", "consistency")
    best = F.max(F.struct(F.col("matched_words").alias("n"), (-F.col("shift")).alias("back"), F.col("consistency").alias("alike"), F.struct(*names).alias("row")))
    found = found.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", F.greatest(F.lit(0), -F.col("best.back")).alias("start_word"), *[F.col(f"best.row.{k}").alias(k) for k in names])
