"""Mining pages, lexica and published texts by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.normalize import clean_source, clean_target
from lexiforge.operators.select import first_per

# Words that head a translation on a page, words that head what follows it, the two forms of a reference,
# and the numbers ahead of a definition.
HEADERS = "Translation|Translat|English|Übersetzung|Traduction"
AFTER = "Commentary|Notes?|Transliteration|Bibliography|References|Discussion|Analysis|Tablet|Text|Obverse|Reverse"
SERIES = r"\b([A-Z]{2,6})\s+(\d{1,3})\s*[,.]?\s*(\d{1,4}[a-z]?)\b"
KT = r"(?i)\b(Kt\s+[a-z]/[a-z]\s+\d+[a-z]?)\b"
NUMBER, NUMERAL, LEMMA_NUMERAL = r"^\d+\.?\s*", r"^[IVX]+\.?\s*", r"\s+[IVX]+$"


def references(page: Column) -> Column:
    """Distinct references of a page, upper case: ``ABBREV n n[a-z]`` and ``Kt x/y n``."""
    group = lambda k: F.regexp_extract_all(page, F.lit(SERIES), F.lit(k))
    series = F.transform(F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c")), lambda x: F.upper(F.concat_ws(" ", x["a"], x["b"], x["c"])))
    kt = F.transform(F.regexp_extract_all(page, F.lit(KT), F.lit(1)), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.concat(series, kt))


def translation_block(page: Column) -> Column:
    """What stands behind the first translation header up to the next header; empty if short or without a word."""
    body = F.regexp_extract(page, rf"(?is)(?:^|\n)\s*(?:{HEADERS})\s*[:.]?\s*\n(.*)\z", 1)
    body = F.trim(F.split(body, rf"(?i)\n\s*(?:{AFTER})\s*[:.]?\s*\n", 2)[0])
    return F.when((F.length(body) > 20) & body.rlike("[a-zA-Z]{3,}"), body).otherwise("")


def identifier_index(texts: DataFrame) -> DataFrame:
    """(identifier, oare_id) from labels, aliases and catalogues of texts(seq, oare_id, ...); the last claim wins."""
    split = lambda c: F.split(F.coalesce(c, F.lit("")), r"\|")
    kinds = [(0, F.array("label")), (1, split(F.col("aliases"))), (2, split(F.col("publication_catalog")))]
    rows = [texts.select("seq", "oare_id", F.lit(k).alias("kind"), F.posexplode(v).alias("pos", "raw")) for k, v in kinds]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("identifier", F.upper(F.trim("raw")))
    every = every.filter(F.length("identifier") > 0)
    return every.groupBy("identifier").agg(F.max_by("oare_id", F.struct("seq", "kind", "pos")).alias("oare_id"))


def page_pairs(pages: DataFrame, texts: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """pages(page_seq, pdf_name, page_text, has_akkadian), texts(seq, ...) -> pairs with their page's source and reference.

    Only flagged pages are mined, where there is a flag.
    """
    if "has_akkadian" in pages.columns:
        pages = pages.filter("has_akkadian")
    p = pages.filter(F.length("page_text") >= 50).select("page_seq", "pdf_name", references(F.col("page_text")).alias("refs"), translation_block(F.col("page_text")).alias("block"))
    p = p.filter(F.length("block") > 0).select("page_seq", "pdf_name", "block", F.explode("refs").alias("reference"))
    first = first_per(texts.select("seq", "oare_id", "transliteration"), ["oare_id"], F.col("seq")).drop("seq")
    j = p.join(identifier_index(texts), p["reference"] == F.col("identifier")).join(first, "oare_id")
    j = j.filter(F.length("transliteration") >= 10)
    j = j.select("page_seq", "oare_id", clean_source(F.col("transliteration")).alias("transliteration"), clean_target(F.col("block")).alias("translation"), F.col("pdf_name").alias("source_pdf"), "reference")
    j = j.filter((F.length("transliteration") > 10) & (F.length("translation") > 10))
    if exclude is not None:
        j = j.join(exclude.select("oare_id"), "oare_id", "left_anti")
    return first_per(j, ["oare_id", "transliteration"], F.col("page_seq"), F.col("reference")).drop("page_seq")


def monolingual(texts: DataFrame, train: DataFrame, least: int = 10) -> DataFrame:
    """Cleaned texts longer than least that aren't in train."""
    fresh = texts.join(train.select("oare_id"), "oare_id", "left_anti")
    # Exploded, so that a text is cleaned once: a filter on it would clean it again.
    kept = F.explode(F.filter(F.array(clean_source(F.col("transliteration"))), lambda t: F.length(t) > least))
    return fresh.withColumn("transliteration", kept)


def with_notes(texts: DataFrame, least: int = 50) -> DataFrame:
    """P10."""
    return texts.filter(F.length("note") > least)


def gloss(definition: Column) -> Column:
    """L1: the first three quoted senses, or what stands before ``;`` or ``(`` without its leading number."""
    quoted = F.filter(F.transform(F.regexp_extract_all(definition, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.trim(F.split(F.trim(definition), "[;(]", 2)[0])
    plain = F.regexp_replace(F.regexp_replace(plain, NUMBER, ""), NUMERAL, "")
    plain = F.trim(F.regexp_replace(plain, '^[" ]+|[" ]+$', ""))
    return F.coalesce(F.when(F.size(quoted) > 0, F.array_join(F.slice(quoted, 1, 3), "; ")).otherwise(plain), F.lit(""))


def dictionary_glosses(dictionary: DataFrame) -> DataFrame:
    """L2: dictionary(seq, word, definition) -> (lemma, gloss), numerals behind a word dropped, the first entry wins."""
    d = dictionary.select("seq", F.trim(F.regexp_replace("word", LEMMA_NUMERAL, "")).alias("lemma"), gloss(F.col("definition")).alias("gloss"))
    return first_per(d.filter((F.length("lemma") > 0) & (F.length("gloss") > 0)), ["lemma"], F.col("seq")).drop("seq")


def form_glosses(lexicon: DataFrame, glosses: DataFrame) -> DataFrame:
    """lexicon(seq, form, lexeme, norm, ...) -> (form, gloss) by lexeme, else by norm; the last form wins."""
    a, b = glosses.select(F.col("lemma").alias("lexeme"), F.col("gloss").alias("g1")), glosses.select(F.col("lemma").alias("norm"), F.col("gloss").alias("g2"))
    j = lexicon.join(a, "lexeme", "left").join(b, "norm", "left").withColumn("gloss", F.coalesce("g1", "g2")).filter("gloss is not null and form is not null")
    return j.groupBy("form").agg(F.max_by("gloss", "seq").alias("gloss"))


def drills(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(transliteration, translation) of word forms, both sides of two characters at least, each pair once."""
    words = lexicon.filter("type = 'word'").select("form")
    d = forms.join(words, "form", "left_semi").filter(F.length("gloss") >= 2)
    d = d.select(clean_source(F.col("form")).alias("transliteration"), F.col("gloss").alias("translation"))
    return d.filter(F.length("transliteration") >= 2).distinct()


def proper_nouns(lexicon: DataFrame) -> DataFrame:
    """(form, normalized, type) of names, by cleaned form, the last wins. A missing norm falls back to the form."""
    n = lexicon.filter(F.col("type").isin("PN", "GN")).select("seq", clean_source(F.col("form")).alias("form"), F.coalesce(F.nullif(F.trim("norm"), F.lit("")), F.col("lexeme"), F.col("form")).alias("normalized"), "type")
    return n.filter(F.length("form") > 0).groupBy("form").agg(F.max_by(F.struct("normalized", "type"), "seq").alias("x")).select("form", "x.normalized", "x.type")


def names_for_templates(lookup: DataFrame) -> DataFrame:
    """(form, normalized) of the persons among proper_nouns' rows, neither side empty."""
    return lookup.filter((F.col("type") == "PN") & (F.length("form") > 0) & (F.length("normalized") > 0)).select("form", "normalized")
