"""Personal data: patterns, then terms that give a protected value away. DataFrame expressions throughout.

Patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers; leftmost, without overlap within a
kind, and a match that fails its test is dropped. Each pattern is written so that it reads a text once: runs are
possessive, and a match starts at the head of a run or where the last match ended.

The values found are the protected entities. Over the whole corpus, documents are counted that have a word and an entity,
the entity, and the word; what stands inside an e-mail address is no word. A word's
disclosure is its pointwise mutual information with the entity over the entity's own information: 1 where the word occurs
only in texts with the entity, 0 where it tells nothing. Words that accompany an entity in at least ``SUPPORT`` distinct
texts are removed from ``REMOVE`` on and generalised from ``GENERALISE`` on to the class of word that their letters
show (an acronym, a name, any other term), wherever they stand in any document; of several entities the one that is
disclosed most counts. Entities of fewer texts have no terms: in one or two texts, any
rare word would have disclosure 1.

Defined results: null text is empty text and has no spans. Rows with the same doc_id are searched each, and those of the
same text count once. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, hold, table

_LOCAL = "A-Za-z0-9._%+-"
#: Kinds in order, and their patterns.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Letters of a word that counts, at least.
LETTERS = 4
SUPPORT = 3
REMOVE, GENERALISE = 0.98, 0.9
#: Most keys of rows with terms that are sent to every task, 8 bytes each, so that other rows' texts stay where they are.
KEYS_SENT = 1 << 20
#: Matches of a text that are placed together.
CHUNK = 128
SPAN = "array<struct<kind:string,start:long,end:long>>"
_WORD = rf"\p{{L}}{{{LETTERS},}}+"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(text)).between(16, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda m: _passes(kind, m["text"])


def _split(text: Column, pattern: str) -> Column:
    """Array of (m, g, h) for each match: its text, the gap before it and the gap after it."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, 2, 1 << 30).alias("h"))
    return F.filter(zipped, lambda x: x["m"].isNotNull())


def _located(parts: Column, made) -> Column:
    """From _split()'s array, one of made(part, start), start in code points; lengths are summed up along the way."""
    size = lambda x: (F.length(x["g"]) + F.length(x["m"])).cast("long")
    place = "struct<text:string,start:long>"
    start = lambda at, kind: F.struct(at.cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["out"], F.array(made(x, a["at"] + F.length(x["g"])))).alias("out"))
    # appending to an array copies it, so matches are taken in chunks, for which the places where they begin come first
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, CHUNK))
    sized = F.transform(chunks, lambda c: F.struct(c.alias("c"), F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + size(x)).alias("n")))
    part = "struct<m:string,g:string,h:string>"
    begun = F.aggregate(sized, start(F.lit(0), f"struct<at:long,c:array<{part}>>"), lambda a, s: F.struct((a["at"] + s["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), s["c"].alias("c")))).alias("out")))["out"]
    found = F.flatten(F.transform(begun, lambda b: F.aggregate(b["c"], start(b["at"], place), step)["out"]))
    return F.when(F.size(parts) > 0, found).otherwise(F.array().cast(f"array<{place}>"))


def _placed(part: Column, at: Column) -> Column:
    return F.struct(part["m"].alias("text"), at.cast("long").alias("start"))


def base(docs: DataFrame) -> DataFrame:
    """docs, and for each kind an array of (text, start): the matches.

    Texts in which nothing could pass the kind's test skip its pattern: without an @, three dots between digits, sixteen
    digits in a run, a plus before a digit."""
    text = F.coalesce("text", F.lit(""))
    may = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][\x20-]?+){15}+[0-9]"),
        "phone": text.contains("+") & text.rlike(r"\+[0-9]"),
    }
    parts = docs.withColumns({f"{k}_parts": F.when(may[k], _split(text, PATTERNS[k])) for k in PATTERNS})
    none = F.array().cast("array<struct<text:string,start:long>>")
    found = {k: F.coalesce(F.filter(_located(F.col(f"{k}_parts"), _placed), _test(k)), none) for k in PATTERNS}
    return parts.withColumns(found).drop(*(f"{k}_parts" for k in PATTERNS))


def _spans() -> Column:
    """The patterns' spans in one array, by kind and start."""
    span = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"))
    return F.concat(*(F.transform(k, span(k)) for k in PATTERNS))


def _key() -> Column:
    """Rows with the same one have the same doc_id and text, null or not."""
    return F.xxhash64("doc_id", "text").alias("_key")


def _shadow() -> Column:
    """The text with blanks in place of e-mail addresses, the only values that have letters."""
    text = F.coalesce("text", F.lit(""))
    parts = _split(text, PATTERNS["email"])
    blank = F.concat(F.array_join(F.transform(parts, lambda x: F.concat(x["g"], F.repeat(F.lit(" "), F.length(x["m"])))), ""), F.element_at(parts, -1)["h"])
    return F.when(text.contains("@") & text.rlike(PATTERNS["email"]), blank).otherwise(text)


def _words(text: Column) -> Column:
    """Distinct words of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, same, known, the kinds, words) of each row; same tells texts apart, known is false for null text."""
    words = _words(_shadow()).alias("words")
    return base(docs.select("doc_id", "text")).select("doc_id", _key(), F.xxhash64("text").alias("same"), F.col("text").isNotNull().alias("known"), *PATTERNS, words)


def disclosing(read: DataFrame) -> DataFrame:
    """(entity, word, disclosure) of the words that give an entity away, from the rows that _read() makes."""
    value = {"email": lambda t: F.lower(t), "ip": lambda t: t, "card": _digits, "phone": _digits}
    entity = lambda kind: lambda m: F.concat(F.lit(kind + ":"), value[kind](m["text"]))
    entities = F.array_distinct(F.concat(*(F.transform(k, entity(k)) for k in PATTERNS)))
    near = read.where(F.greatest(*(F.size(k) for k in PATTERNS)) > 0).select("_key", "same", F.explode(entities).alias("entity")).distinct()
    entity = near.groupBy("entity", "same").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"))
    # an entity of fewer texts has no word in SUPPORT of them
    entity = hold(entity.where(F.col("texts") >= SUPPORT).drop("texts"))
    pairs = near.join(entity, "entity", "left_semi")
    rows = read.select("_key", "words").join(pairs.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    seen = pairs.join(rows.select("_key", F.explode("words").alias("word")), "_key")
    together = seen.groupBy("entity", "word", "same").agg(F.count("*").alias("n")).groupBy("entity", "word").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    together = hold(together.where(F.col("texts") >= SUPPORT).drop("texts"))
    # counted over the whole corpus before anything is joined, so that the join has one row for each word
    word = read.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_word"))
    total = read.where("known").agg(F.count("*").alias("n"))
    rows = together.join(entity, "entity").join(word, "word").crossJoin(F.broadcast(total))
    mutual = F.log(F.col("n") * F.col("both") / (F.col("n_entity") * F.greatest("n_word", "both")))
    rows = rows.where("n_entity < n").withColumn("disclosure", F.greatest(F.lit(0.0), mutual / F.log(F.col("n") / F.col("n_entity"))))
    return rows.where(F.col("disclosure") >= GENERALISE).select("entity", "word", "disclosure")


def _told(read: DataFrame) -> DataFrame:
    """(_key, _told) of the rows that have terms: a map from term to kind."""
    kind = F.when(F.max("disclosure") >= REMOVE, "term_removed").otherwise("term_generalised")
    terms = hold(disclosing(read).groupBy("word").agg(kind.alias("kind")))
    told = read.select("_key", F.explode("words").alias("word")).join(terms, "word")
    return told.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("word", "kind"))).alias("_told"))


def _with_terms(rows: DataFrame) -> DataFrame:
    """rows with "_terms": spans of a row's terms, by kind and place, from its text and "_told".

    The text's words are a column of their own before they are placed, so that they are looked for once."""
    known = F.col("_told").isNotNull()
    rows = rows.withColumn("_parts", F.when(known, _shadow())).withColumn("_parts", F.when(known, _split(F.col("_parts"), _WORD)))
    span = lambda w: F.struct(F.try_element_at("_told", F.lower(w["text"])).alias("kind"), w["start"].alias("start"), (w["start"] + F.length(w["text"])).alias("end"))
    found = F.array_sort(F.filter(F.transform(_located(F.col("_parts"), _placed), span), lambda e: e["kind"].isNotNull()))
    return rows.withColumn("_terms", F.when(known, found).otherwise(F.array().cast(SPAN))).drop("_parts", "_told")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with the patterns' arrays of base(), and "spans": array of (kind, start, end)."""
    rows = base(docs).withColumn("_key", _key()).join(_told(hold(_read(docs))), "_key", "left")
    return _with_terms(rows).withColumn("spans", F.concat(_spans(), F.col("_terms"))).drop("_key", "_terms")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, the patterns' arrays and "spans" as sanitise() has them. Only rows with terms are read again, no text of
    the others moves."""
    read = hold(_read(docs))
    told = hold(_told(read))
    texts = docs.select(_key(), "text")
    if told.count() <= KEYS_SENT:
        texts = texts.join(F.broadcast(told.select("_key")), "_key", "left_semi")  # then only their texts are shuffled
    extra = _with_terms(texts.join(told, "_key")).groupBy("_key").agg(F.first("_terms").alias("extra"))
    rows = read.select("doc_id", "_key", *PATTERNS).join(extra, "_key", "left")
    return rows.select("doc_id", *PATTERNS, F.concat(_spans(), F.coalesce("extra", F.array().cast(SPAN))).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, as a placeholder: the kind, nothing for removed terms, the
    class of word for generalised ones."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    part = lambda s: F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    shape = lambda s: F.when(part(s).rlike(r"^\p{Lu}+$"), "[ACRONYM]").when(part(s).rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
    label = lambda s: F.when(s["kind"] == "term_removed", "").when(s["kind"] == "term_generalised", shape(s)).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), label(s)))).otherwise(a["out"]).alias("out"))
    return F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return rows.select("doc_id", *counts, F.sha2(listed(_spans()), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data and the terms that give it away are replaced in the text; n_chars follows."""
    names = docs.columns
    inner, boxed = carried(docs, {*PATTERNS, *(f"{k}_parts" for k in PATTERNS), "spans", "_key", "_told", "_parts", "_terms"})
    rows = sanitise(inner).withColumn("text", F.when(F.size("spans") > 0, rewritten(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    kept = lambda c: F.col(f"row.`{c}`") if boxed else F.col(f"`{c}`")
    return rows.select(*(new[c].alias(c) if c in new else kept(c).alias(c) for c in names))
