"""Aligning documents with their sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiforge.functions.quality import pair_by_words, words
from lexiforge.functions.segment import english_clauses, proportional_segments, source_clauses, word_share_segments
from lexiforge.operators.select import first_per

# Formulas that stand on both sides of a translation, in the order in which they are tried.
ANCHORS = (
    ("KISIB", r"\bKIŠIB\b", r"\bSeal\s+of\b"),
    ("UMMA_QIBI", r"\bum-ma\b.{1,120}?\bqí-bi[₄4]?-ma\b", r"\bFrom\b.{1,120}?:"),
    ("UMMA", r"\bum-ma\b", r"\b(?:Thus|says?|said)\b"),
    ("ANA_QIBI", r"\ba-na\b.{1,80}?\bqí-bi[₄4]?-ma\b", r"\bTo\b.{1,80}?:"),
    ("IGI", r"\bIGI\b", r"\b(?:Witnessed\s+by|Witnesses?:?|Before)\b"),
    ("LIMUM", r"\bli-mu(?:-um)?\b", r"\beponymy?\b|\beponymate\b"),
)
PAIRS = T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("tgt", T.StringType())]))


#: Sentences of a document that are cut out of its words together.
TOGETHER = 1024


def sentence_slices(docs: DataFrame, sents: DataFrame) -> DataFrame:
    """A1: docs(doc_id, src), sents(doc_id, ord, tgt, first_word) -> (doc_id, ord, src, tgt).

    A sentence's words go from its first word to that of the next sentence that has one. Sentences without
    text don't count; those with blank text or without a first word end others but give no row. A document's sentences are gathered,
    TOGETHER at most, and meet its words once, so that memory grows with the text and not with the text times its sentences.
    """
    ordered = Window.partitionBy("doc_id").orderBy("ord")
    later = ordered.rowsBetween(1, Window.unboundedFollowing)
    s = sents.filter("tgt is not null").withColumn("start", F.col("first_word").cast("int") - 1)
    s = s.withColumns({"next": F.first("start", ignorenulls=True).over(later), "part": F.floor((F.row_number().over(ordered) - 1) / TOGETHER)})
    s = s.filter(F.col("start").isNotNull() & (F.trim("tgt") != ""))
    gathered = s.groupBy("doc_id", "part").agg(F.collect_list(F.struct("ord", F.trim("tgt").alias("tgt"), "start", "next")).alias("sentences"))
    t = docs.select("doc_id", words(F.col("src")).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")

    def cut(x: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(x["start"], n - 1))
        stop = F.greatest(start + 1, F.least(F.coalesce(x["next"], n), n))
        return F.struct(x["ord"].alias("ord"), F.array_join(F.slice("w", start + 1, stop - start), " ").alias("src"), x["tgt"].alias("tgt"))

    return gathered.join(t, "doc_id").select("doc_id", F.explode(F.transform("sentences", cut)).alias("x")).select("doc_id", "x.ord", "x.src", "x.tgt")


def with_fallback(docs: DataFrame, sliced: DataFrame) -> DataFrame:
    """documents(doc_id, src, tgt) without a sliced row are shared out by characters; a column says which way.

    Documents with a blank side have no rows.
    """
    some = docs.filter(_said("src") & _said("tgt"))
    rest = some.join(sliced, "doc_id", "left_anti")
    shared = rest.select("doc_id", F.posexplode(proportional_segments(F.col("src"), F.col("tgt"))).alias("ord", "x"))
    shared = shared.select("doc_id", F.col("ord").cast("int").alias("ord"), "x.src", "x.tgt", F.lit("proportional").alias("method"))
    kept = sliced.join(some.select("doc_id"), "doc_id", "left_semi")
    return kept.select("doc_id", F.col("ord").cast("int").alias("ord"), "src", "tgt", F.lit("sentences").alias("method")).unionByName(shared)


def _said(column: str):
    return F.coalesce(F.col(column).rlike(r"(?U)\S"), F.lit(False))


def method_counts(docs: DataFrame, aligned: DataFrame) -> DataFrame:
    """AG8: (method, documents, pairs) of with_fallback's rows; ``skipped`` are the documents without any."""
    of = aligned.groupBy("doc_id", "method").agg(F.count("*").alias("pairs"))
    every = docs.select("doc_id").distinct().join(of, "doc_id", "left").select(F.coalesce("method", F.lit("skipped")).alias("method"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
    return every.groupBy("method").agg(F.count("*").alias("documents"), F.sum("pairs").alias("pairs"))


def shared_method_counts(docs: DataFrame, sents: DataFrame, by: str = "doc_id") -> DataFrame:
    """method_counts of with_fallback over sentence_slices, counted without making the slices.

    docs(doc_id, src, tgt) and sents(ord, tgt, first_word) meet by a column that both have. Documents that share their sentences name the list
    that they share; each list is counted once, so that work grows with documents and sentences, not with their product.
    """
    cut = F.col("first_word").cast("int").isNotNull() & (F.trim("tgt") != "")
    n = sents.filter(cut).groupBy(by).agg(F.count("*").alias("_n"))
    both, sliced = _said("src") & _said("tgt"), F.col("_n").isNotNull()
    pairs = F.when(~both, F.lit(0)).when(sliced, F.col("_n")).otherwise(F.size(proportional_segments(F.col("src"), F.col("tgt"))))
    of = docs.join(n, by, "left").select("doc_id", (both & sliced).alias("sliced"), pairs.cast("long").alias("pairs"))
    of = of.groupBy("doc_id", "sliced").agg(F.sum("pairs").alias("pairs"))
    method = F.when(F.col("sliced"), "sentences").when(F.col("pairs") > 0, "proportional").otherwise("skipped")
    return of.groupBy(method.alias("method")).agg(F.count("*").alias("documents"), F.sum("pairs").alias("pairs"))


def merge_pairs(existing: DataFrame, new: DataFrame, keys: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """The existing pairs that aren't among the new ones, and the new ones; blank sides are left out."""
    kept = existing.select(*keys).join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*keys)).filter(_said(keys[0]) & _said(keys[1]))


def gate_pairs(pairs: DataFrame, *order, keys: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """Each stripped pair that passes Q6, once, at its first place in the order."""
    bare = [F.regexp_replace(k, r"(?U)^\s+|\s+$", "").alias(k) for k in keys]
    rows = pairs.select(*[c for c in pairs.columns if c not in keys], *bare).filter(pair_by_words(F.col(keys[0]), F.col(keys[1])))
    return first_per(rows, list(keys), *order)


def find_anchors(text: str, side: int) -> list[tuple[int, str]]:
    """A5: (start, label), by start and then the order of the formulas."""
    return sorted(((m.start(), label) for label, *pats in ANCHORS for m in re.finditer(pats[side], text, re.I | re.S)), key=lambda x: x[0])


def anchored_pairs(src: str | None, tgt: str | None) -> list[tuple[str, str]]:
    """Both sides cut at the anchors that match in order; nothing without a match."""
    a, b = find_anchors(src or "", 0), find_anchors(tgt or "", 1)
    cuts, j = [], 0
    for at, label in a:
        k = next((i for i in range(j, len(b)) if b[i][1] == label), None)
        if k is not None:
            cuts.append((at, b[k][0]))
            j = k + 1
    if not cuts:
        return []
    x = [0, *(c for c, _ in cuts), len(src)]
    y = [0, *(c for _, c in cuts), len(tgt)]
    spans = [(src[x[i] : x[i + 1]].strip(), tgt[y[i] : y[i + 1]].strip()) for i in range(len(x) - 1)]
    return [p for p in spans if all(p)]


@F.pandas_udf(PAIRS)
def _anchored(src: pd.Series, tgt: pd.Series) -> pd.Series:
    return pd.Series([[{"src": a, "tgt": b} for a, b in anchored_pairs(x, y)] for x, y in zip(src, tgt, strict=True)])


def align_documents(docs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """A10: anchors; one sentence; as many clauses, two at least, on either side; else words by share. Adds ``pairs`` and ``how``.

    A blank side gives no pairs and ``none``. Any pair of anchors is enough. Columns of docs called pairs or how are replaced.
    """
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    s, t = F.col("_src"), F.col("_tgt")
    kept = [c for c in docs.columns if c not in ("pairs", "how")]
    d = docs.select(*kept, F.coalesce(bare(F.col(src)), F.lit("")).alias("_src"), F.coalesce(bare(F.col(tgt)), F.lit("")).alias("_tgt"))
    d = d.select("*", _anchored(s, t).alias("_a"), english_clauses(t).alias("_e"), source_clauses(s).alias("_s"))
    one = F.array(F.struct(s.alias("src"), t.alias("tgt")))
    same = F.arrays_zip(F.col("_s").alias("src"), F.col("_e").alias("tgt"))
    cases = [
        ("none", (s == "") | (t == ""), F.array().cast(PAIRS)),
        ("anchors", F.size("_a") > 0, F.col("_a")),
        ("single", F.size("_e") <= 1, one),
        ("zip", F.size("_e") == F.size("_s"), same),
        ("share", F.lit(True), word_share_segments(s, F.col("_e"))),
    ]
    pairs, how = F.lit(None), F.lit(None)
    for name, when, value in reversed(cases):
        pairs, how = F.when(when, value).otherwise(pairs), F.when(when, F.lit(name)).otherwise(how)
    return d.select(*kept, pairs.alias("pairs"), how.alias("how"))


def parse_reply(reply: Column) -> Column:
    """array<struct<akkadian, english>> of a model's reply; elements that aren't objects are skipped, other JSON is empty."""
    bare = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    items = F.when(bare.startswith("["), F.from_json(bare, "array<string>"))
    items = F.coalesce(items, F.when(inner != "", F.from_json(inner, "array<string>")), F.array().cast("array<string>"))
    made = F.transform(F.filter(items, lambda x: x.startswith("{")), lambda x: F.from_json(x, "akkadian string, english string"))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return F.filter(made, lambda x: (F.length(text(x["akkadian"])) > 3) & (F.length(text(x["english"])) > 3))


PROMPT = "Align the source with its translation, sentence by sentence. Answer with a JSON list of objects with the keys akkadian and english.\n\nSource:\n{src}\n\nTranslation:\n{tgt}\n"


def ask(docs: DataFrame, call: Callable[[str], str], limit: int = 3000) -> DataFrame:
    """A11, IO14: docs(doc_id, src, tgt) -> (doc_id, response, error). call runs on the executors, once per document.

    A call that fails gives no response and its error's text, so that the caller can tell and ask again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(src: str, tgt: str) -> tuple[str | None, str | None]:
            try:
                return call(PROMPT.format(src=(src or "")[:limit], tgt=(tgt or "")[:limit])), None
            except Exception as e:  # the service's own errors, of any kind
                return None, f"{type(e).__name__}: {e}"

        for part in parts:
            got = [one(a, b) for a, b in zip(part["src"], part["tgt"], strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "response": [r for r, _ in got], "error": [e for _, e in got]})

    return docs.select("doc_id", "src", "tgt").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, response string, error string")
