"""Synthetic pairs: templates, pseudo-labels and span corruption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.functions.arrays import let, places
from lexiforge.functions.normalize import clean_source, clean_target
from lexiforge.operators.decode import translate
from lexiforge.operators.select import free_name, keyed_hash, ranked

# Bilingual formulas with slots, and what fills the slots that aren't names.
TEMPLATES = (
    ("{amount} ma-na {quality} KÙ.BABBAR i-ṣé-er {debtor} {creditor} i-šu", "{amount} minas of {quality_eng} silver — {debtor_eng} owes {creditor_eng}."),
    ("{amount} GÍN KÙ.BABBAR i-ṣé-er {debtor} {creditor} i-šu", "{amount} shekels of silver — {debtor_eng} owes {creditor_eng}."),
    ("um-ma {sender}-ma a-na {recipient} qí-bi-ma", "Thus {sender_eng}: Say to {recipient_eng}:"),
    ("a-na {recipient} qí-bi-ma um-ma {sender}-ma", "Say to {recipient_eng}: Thus {sender_eng}:"),
    ("KIŠIB {person} DUMU {father}", "Seal of {person_eng} son of {father_eng}."),
    ("IGI {witness1} IGI {witness2}", "Witness: {witness1_eng}. Witness: {witness2_eng}."),
    ("{amount} ma-na KÙ.BABBAR a-na {recipient} dí-in", "Give {amount} minas of silver to {recipient_eng}."),
)
SLOTS = ("sender", "recipient", "debtor", "creditor", "person", "father", "witness1", "witness2")
AMOUNTS = ("1", "2", "3", "5", "10", "15", "20", "30")
QUALITIES = (("SIG5", "refined"), ("ṣa-ru-pá-am", "refined"))
#: Names that one pair draws from; slot i takes name i modulo their number.
DRAWN = 4


def template_pairs(spark: SparkSession, names: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """G1: names(form, normalized) -> (transliteration, translation), n per template, by keyed draws.

    Names are numbered by keyed order, and each pair joins the DRAWN names it draws by number. A pair
    stays if all its slots are filled; determinatives in names, such as ``{d}``, don't count as slots.
    """
    total = names.count()
    if not total:
        return spark.createDataFrame([], "transliteration string, translation string")
    rows = spark.createDataFrame([(t, a, b) for t, (a, b) in enumerate(TEMPLATES)], "t int, src string, tgt string")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draw = lambda what, m: F.pmod(keyed_hash(F.lit(what), "t", "i", seed=seed), F.lit(m)).cast("int")
    numbered = ranked(names, keyed_hash("form", seed=seed), "form", "normalized").select((F.col("_rank") - 1).cast("int").alias("no"), "form", "normalized")
    used = min(DRAWN, total)
    # Neighbours in keyed order, so that the drawn names differ.
    picks = rows.select("t", "i", F.explode(F.sequence(F.lit(0), F.lit(used - 1))).alias("k")).withColumn("no", F.pmod(draw("name", total) + F.col("k"), F.lit(total)))
    drawn = picks.join(numbered, "no").groupBy("t", "i").agg(F.sort_array(F.collect_list(F.struct("k", "form", "normalized"))).alias("names"))
    rows = rows.join(drawn, ["t", "i"])
    pick = lambda what, values: F.element_at(F.array(*map(F.lit, values)), draw(what, len(values)) + 1)
    fills = {"amount": pick("amount", AMOUNTS), "quality": pick("quality", [a for a, _ in QUALITIES]), "quality_eng": pick("quality", [b for _, b in QUALITIES])}
    for i, slot in enumerate(SLOTS):
        fills |= {slot: F.col("names")[i % used]["form"], f"{slot}_eng": F.col("names")[i % used]["normalized"]}
    src, tgt = F.col("src"), F.col("tgt")
    for slot, value in fills.items():
        src, tgt = F.replace(src, F.lit("{%s}" % slot), value), F.replace(tgt, F.lit("{%s}" % slot), value)
    open_ = r"\{(?:%s)\}" % "|".join(fills)
    made = rows.select(src.alias("src"), tgt.alias("tgt")).filter(~F.col("src").rlike(open_) & ~F.col("tgt").rlike(open_))
    return made.select(clean_source(F.col("src")).alias("transliteration"), clean_target(F.col("tgt")).alias("translation"))


def pseudo_labels(texts: DataFrame, load, order: str, text: str = "transliteration", most: int = 5000, least: int = 5, batch: int = 16) -> DataFrame:
    """(order, transliteration, translation, source) of the first ``most`` texts in the order, translated by load's function.

    Translations of ``least`` characters or fewer are dropped, the others cleaned. Null texts don't count.
    """
    some = texts.filter(F.col(text).isNotNull()).orderBy(order).limit(most).select(order, text)
    made = translate(some, load, text, order, batch)
    rows = some.join(made, order).filter(F.length("prediction") > least)
    return rows.select(order, F.col(text).alias("transliteration"), clean_target(F.col("prediction")).alias("translation"), F.lit("pseudo_label").alias("source"))


#: The byte vocabulary's first and last sentinel, its padding and end, and what a loss leaves out.
SENTINELS = (259, 383)
PAD, END, NO_LOSS = 0, 1, -100
#: Ids that a text is cut to, its end included.
MOST = 512


def span_corruption(rows: DataFrame, tokens: str = "tokens", share: float = 0.15, most: int | None = MOST, sentinels: tuple[int, int] = SENTINELS, end: int = END, seed: int = 42) -> DataFrame:
    """Adds input_ids and label_ids: of the first ``most`` tokens (None: all) that share is masked, one token at least.

    Masked are the places with the smallest keyed hashes of tokens and place. Neighbouring masked places are a span and share a
    sentinel, counted upwards from the first; once the last is given out, what follows stays as it is, so ids never leave the
    vocabulary and labels always tell the tokens. Rows of under five tokens, or null ones, are dropped. Texts and labels are put together from slices
    between spans, so long lists take the time of sorting their hashes.
    """
    names = list(dict.fromkeys([*rows.columns, "input_ids", "label_ids"]))
    first, last = sentinels
    cut = F.col(tokens) if most is None else F.slice(tokens, 1, most)
    made = rows.filter(F.size(tokens) >= 5)

    def masked(t: Column) -> Column:
        """Whether each place is masked."""
        count = F.greatest(F.lit(1), F.floor(F.size(t) * share).cast("int"))
        hashes = lambda k: F.transform(t, lambda x, i: F.struct(keyed_hash(k, i.cast("string"), seed=seed).alias("h"), i.alias("i")))
        under = lambda h: let(F.get(F.sort_array(h), count - 1), lambda bound: F.transform(h, lambda x: x <= bound))
        return let(F.md5(F.array_join(t.cast("array<string>"), " ")), lambda k: let(hashes(k), under))

    def spans(m: Column) -> Column:
        """Where each span begins, where it ends, and where the one ahead of it ends."""
        no = F.array(F.lit(False))
        changes = lambda a, b: F.slice(places(F.zip_with(a, b, lambda x, y: x & ~y)), 1, last - first + 1)
        begins, ends = changes(F.concat(m, no), F.concat(no, m)), changes(F.concat(no, m), F.concat(m, no))
        return let(ends, lambda e: F.arrays_zip(begins.alias("a"), e.alias("b"), F.slice(F.concat(F.array(F.lit(0)), e), F.lit(1), F.size(e)).alias("from")))

    def both(t: Column, s: Column) -> Column:
        stop = F.array(F.lit(end))
        mark = lambda i: F.array((i + first).cast("int"))
        part = lambda a, b: F.slice(t, a + 1, b - a).cast("array<int>")
        a = F.concat(F.flatten(F.transform(s, lambda x, i: F.concat(part(x["from"], x["a"]), mark(i)))), part(F.element_at(s, -1)["b"], F.size(t)), stop)
        return F.struct(a.alias("input_ids"), F.concat(F.flatten(F.transform(s, lambda x, i: F.concat(mark(i), part(x["a"], x["b"])))), stop).alias("label_ids"))

    out = let(cut, lambda t: let(masked(t), lambda m: let(spans(m), lambda s: both(t, s))))
    made = made.select(*[c for c in rows.columns if c not in ("input_ids", "label_ids")], F.explode(F.array(out)).alias(free_name(rows.columns, "made")))
    x = made.columns[-1]
    return made.select(*[F.col(x)[c].alias(c) if c in ("input_ids", "label_ids") else F.col(c) for c in names])


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes plus 3; null gives none."""
    hex_ = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    pairs = F.regexp_extract_all(hex_, F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int") + 3)


def byte_examples(pairs: DataFrame, src: str = "src", tgt: str = "tgt", most: int = MOST, most_labels: int = MOST) -> DataFrame:
    """Adds input_ids and labels: both sides' byte ids, cut so that they have so many with the end. Null sides are the end alone."""
    ids = lambda c, n: F.concat(F.slice(byte_ids(F.substring(c, 1, n - 1)), 1, n - 1), F.array(F.lit(END)))  # noqa: E731  a character has a byte at least
    return pairs.withColumns({"input_ids": ids(F.col(src), most), "labels": ids(F.col(tgt), most_labels)})


def padded(examples: DataFrame, batch: str) -> DataFrame:
    """The examples of each batch at its longest's length: input_ids padded, attention_mask (1 where they aren't), and labels, whose padding bears no loss.

    Batches are the caller's, of bounded size; other columns stay. Columns with the names of the added ones are replaced.
    """
    w = Window.partitionBy(batch)
    fill = lambda c, n, by: F.concat(c, F.array_repeat(F.lit(by), (n - F.size(c)).cast("int")))
    a, b = free_name(examples.columns, "most_ids"), free_name(examples.columns, "most_labels")
    wide = examples.withColumns({a: F.max(F.size("input_ids")).over(w), b: F.max(F.size("labels")).over(w)})
    ones = F.array_repeat(F.lit(1), F.size("input_ids"))
    return wide.withColumns({"attention_mask": fill(ones, F.col(a), 0), "input_ids": fill(F.col("input_ids"), F.col(a), PAD), "labels": fill(F.col("labels"), F.col(b), NO_LOSS)}).drop(a, b)


def length_buckets(examples: DataFrame, budget: int, key: str, length: str = "length") -> DataFrame:
    """(key, length, batch, width): examples of about the same length in batches of which none has more than budget ids with its padding.

    Examples go by length and key into ranges, and each range fills its batches on its own: places are numbered within a
    length, and a batch holds budget / length of them, so that padding comes up only where keys of a length run out. Examples longer than the budget are
    batches of their own. width: the batch's longest.
    """
    n = F.greatest(F.col(length), F.lit(1))
    # Lengths are rounded up to a sixteenth of their power of two, so that batches fill; width is what a batch is padded to.
    step = F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(n)) - 4).cast("int"))
    width = (F.ceil(n / step) * step).cast("int")
    wide = examples.select(key, length, F.when(width > budget, F.col(length)).otherwise(width).alias("width"))
    holds = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("width"))).cast("int")
    # A width's examples are dealt out by hash into parts of about a thousand batches, each numbered by itself.
    counts = wide.groupBy("width").agg(F.count("*").alias("n"))
    parts = counts.select("width", F.ceil(F.col("n") / (1000 * F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("width"))))).cast("int").alias("parts"))
    dealt = wide.join(parts, "width").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))
    place = F.row_number().over(Window.partitionBy("width", "part").orderBy(length, key)) - 1
    batch = F.concat_ws("-", "width", "part", F.floor(place / holds))
    return dealt.select(key, length, batch.alias("batch"), "width")
