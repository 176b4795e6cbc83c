"""Information-theoretic sanitisation of personal data (operator 4).

Pattern rules find the protected entities: e-mail addresses, IP addresses, card and phone numbers. The
corpus then tells what else gives them away. For a term t and an entity c, the pointwise mutual information
log2(P(t, c) / (P(t) P(c))) is what t discloses of the -log2 P(c) bits of c; it is estimated from the words
next to the entity's mentions against all words of the corpus. A term that discloses more than the share
``threshold`` of an entity's information is removed (entity: one value) or generalised (entity: a whole
kind). Only DataFrame functions are used.

Patterns are written so that a text is scanned once: possessive repeats, and a look-behind that keeps a
failed run from being tried again at each of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions.arrays import let
from codexflow.llm.common import written

LOCAL = "[A-Za-z0-9._%+-]"
# fixed values: the given base patterns, as (pattern, cheap test without which no match can count)
PATTERNS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = (*PATTERNS, "term")
WORDS_BESIDE, CHARS_BESIDE = 6, 120
BLOCK = 512
LETTERS = r"\p{L}"


def _counts(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        weighed = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
        luhn = F.aggregate(weighed, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0
        return F.when(F.length(digits).between(12, 19), luhn).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def scan(values: Column, combine, kind: str = "bigint", part: int = 256) -> Column:
    """Running results of ``combine`` over an array, in parts, so that no long array is appended to item by item."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def walk(items):
        step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(combine(F.get(acc, F.size(acc) - 1), x))))
        return F.aggregate(items, none, step)

    def whole(parts):
        ends = walk(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(
            F.transform(p, lambda x: combine(F.get(e, i - 1), x))))))

    cuts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / part).cast("int"))
    return F.when(F.size(values) == 0, none).otherwise(let(F.transform(cuts, lambda c: walk(F.slice(values, c * part + 1, part))), whole))


def blocks_of(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points, so that a place is found without counting from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of the text."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(F.greatest(end - 1, start) / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _located(text: Column, matches: Column, pattern: Column, kind: str, order: int) -> Column:
    """Where the matches stand: the pieces between them are what the same pattern splits off."""
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match")), lambda p: p["match"].isNotNull())
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>)")

    def told(zipped):
        ends = scan(F.transform(zipped, lambda p: (F.length(p["gap"]) + F.length(p["match"])).cast("long")), lambda x, y: x + y)
        return let(ends, lambda e: F.transform(zipped, lambda p, i: F.struct(
            (F.get(e, i) - F.length(p["match"])).alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"),
            F.get(e, i).alias("end"), p["match"].alias("value"))))

    return F.when(F.size(matches) > 0, let(pairs, told)).otherwise(none)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (with a non-null text) plus ``base``: array of (start, rank, kind, end, value), sorted, in code points."""
    text = F.col(text_col)
    hits = {f"_{k}": F.when(text.contains(test) if k == "email" else text.rlike(test), F.regexp_extract_all(text, F.lit(p), F.lit(0)))
            .otherwise(F.array().cast("array<string>")) for k, (p, test) in PATTERNS.items()}
    counting = lambda k: lambda s: _counts(k, s["value"])
    placed = {f"_{k}": F.filter(_located(text, F.col(f"_{k}"), F.lit(p), k, i), counting(k)) for i, (k, (p, _)) in enumerate(PATTERNS.items())}
    return (docs.withColumns(hits).withColumns(placed)
            .withColumn("base", F.array_sort(F.concat(*(F.col(f"_{k}") for k in PATTERNS)))).drop(*(f"_{k}" for k in PATTERNS)))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), rf"[^{LETTERS}]+"), lambda w: F.length(w) >= 3)


def contexts(spans: DataFrame) -> DataFrame:
    """(entity, words, source) for every mention: up to six words within 120 characters on either side.

    A mention stands for its value and for its kind. ``source`` is a sketch of the text it stands in, the smallest
    hash of its three-word shingles, which copies share and near copies mostly share.
    """
    shingles = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 3)))
    clean = lambda side: words_of(F.regexp_replace(side, r"\S*@\S*", " "))

    def beside(blocks, size, m):
        first, end = F.greatest(m["start"] - CHARS_BESIDE, F.lit(0)), F.least(m["end"] + CHARS_BESIDE, size)
        left, right = cut(blocks, first, m["start"]), cut(blocks, m["end"], end)
        left = F.when(first > 0, F.regexp_replace(left, rf"^{LETTERS}+", "")).otherwise(left)  # no half words
        right = F.when(end < size, F.regexp_replace(right, rf"{LETTERS}+$", "")).otherwise(right)
        last = let(clean(left), lambda w: F.slice(w, F.greatest(F.size(w) - WORDS_BESIDE + 1, F.lit(1)), WORDS_BESIDE))
        return F.struct(m["kind"].alias("kind"), m["value"].alias("value"), F.concat(last, F.slice(clean(right), 1, WORDS_BESIDE)).alias("words"))

    # both columns are made in the text's row, before its mentions become rows
    mentions = F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value")))
    size = F.length("text").cast("long")
    told = spans.filter(F.size("base") > 0).select(
        let(words_of(F.col("text")), lambda w: F.array_min(shingles(w))).alias("source"),
        let(blocks_of(F.col("text")), lambda b: let(size, lambda n: F.transform(mentions, lambda m: beside(b, n, m)))).alias("told"))
    seen = told.select("source", F.explode_outer("told").alias("m")).select("source", "m.*")
    name = F.when(F.col("kind") == "email", F.lower("value")).otherwise(F.regexp_replace("value", "[^0-9.]", ""))
    return seen.select(F.explode(F.array(F.col("kind"), F.concat_ws(":", "kind", F.sha2(name, 256)))).alias("entity"), "words", "source")


def disclosing_terms(docs: DataFrame, spans: DataFrame, threshold: float, support: int) -> DataFrame:
    """(term, removed): terms that disclose more than ``threshold`` of an entity's information.

    A rare word seen beside an entity by chance is no evidence, nor are copies and near copies of one passage.
    Evidence is the number of different contexts, told apart by the smallest hash of the other words, or of
    different texts, told apart by their ``source``, whichever is larger; it must reach ``support``. Further rows
    never lower it. Counts cover the whole corpus.
    """
    seen = contexts(spans).select("entity", "words", "source", F.explode("words").alias("term"))
    context = F.array_min(F.transform(F.array_remove("words", F.col("term")), lambda w: F.xxhash64(w)))
    sketches = F.array(F.struct(F.lit(True).alias("near"), context.alias("hash")), F.struct(F.lit(False).alias("near"), F.col("source").alias("hash")))
    pairs = (seen.select("entity", "term", F.explode(sketches).alias("s")).groupBy("entity", "term", "s.near", "s.hash").agg(F.count("*").alias("n"))
             .groupBy("entity", "term").agg(F.sum(F.when(F.col("near"), F.col("n"))).cast("double").alias("together"),
                                            F.greatest(F.count_if("near"), F.count_if(~F.col("near"))).alias("contexts")))
    pairs = written(pairs, "cooccurrence")
    corpus = docs.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    corpus = written(corpus, "words")
    total = corpus.agg(F.sum("n")).first()[0] or 1
    entities = pairs.groupBy("entity").agg(F.sum("together").alias("near"))
    told = (pairs.filter(F.col("contexts") >= support).join(corpus, "term").join(entities, "entity")
            .withColumn("information", -F.log2(F.col("near") / total))
            .withColumn("disclosed", F.log2(F.least(F.col("together") / F.col("n"), F.lit(1.0))) + F.col("information")))
    return (told.filter((F.col("information") > 0) & (F.col("disclosed") >= threshold * F.col("information")))
            .groupBy("term").agg(F.max(F.col("entity").contains(":")).alias("removed")))


def find(docs: DataFrame, threshold: float = 0.8, support: int = 5, broadcast_bytes: int = 64 << 20, broadcast_terms: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``spans``: array of (start, rank, kind, end, value), by start, then in the order of the kinds.

    Base spans follow the patterns; ``term`` spans are the occurrences of disclosing terms outside them, with
    the value ``removed`` or ``generalised``. Null texts count as empty and have no span; repeated rows get
    the same spans each. All columns of ``docs`` are kept, a column named ``spans`` is replaced.
    """
    docs = docs.drop("spans")
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = base_spans(named)
    terms = written(disclosing_terms(named, spans, threshold, support), "disclosing")
    # which texts hold such a term: distinct words per text, met with the terms where the text lies
    terms = F.broadcast(terms) if terms.count() <= broadcast_terms else terms  # some 50 bytes a row; beyond that the words are shuffled
    key = F.unhex(F.sha2("text", 256))
    held = (named.select(key.alias("key"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).join(terms, "term")
            .groupBy("key").agg(F.collect_set(F.struct("term", "removed")).alias("terms")))
    held = written(held, "texts-with-terms")
    size = held.agg(F.sum(F.lit(100) + 60 * F.size("terms"))).first()[0] or 0
    held = F.broadcast(held) if size <= broadcast_bytes else held  # beyond that the texts are shuffled once
    marked = spans.withColumn("key", key).join(held, "key", "left")
    pattern = lambda removed: F.concat(F.lit(rf"(?iu)(?<!{LETTERS})(?:"), F.array_join(F.transform(
        F.filter("terms", lambda t: t["removed"] == removed), lambda t: t["term"]), "|"), F.lit(rf")(?!{LETTERS})"))
    some = lambda removed: F.exists(F.coalesce("terms", F.array().cast(held.schema["terms"].dataType)), lambda t: t["removed"] == removed)
    none = F.array().cast("array<string>")
    found = {f"_t{int(r)}": F.when(some(r), F.regexp_extract_all("text", pattern(r), F.lit(0))).otherwise(none) for r in (True, False)}
    labelled = lambda r: F.transform(
        _located(F.col("text"), F.col(f"_t{int(r)}"), F.when(some(r), pattern(r)).otherwise("x"), "term", len(PATTERNS)),
        lambda s: s.withField("value", F.lit("removed" if r else "generalised")))
    extra = F.concat(labelled(True), labelled(False))
    out = marked.withColumns(found).withColumn("extra", extra)
    spans = F.when(F.size("extra") == 0, F.col("base")).otherwise(let(F.array_sort(F.concat("base", "extra")), without_overlaps))
    return out.select("_row.*", spans.alias("spans"))


def without_overlaps(spans: Column) -> Column:
    """Sorted spans without the terms that overlap one of the others."""
    is_term = lambda s: s["kind"] == "term"
    far = F.lit(1 << 62)
    ends = scan(F.transform(spans, lambda s: F.when(is_term(s), F.lit(0).cast("long")).otherwise(s["end"])), F.greatest)
    starts = F.reverse(scan(F.reverse(F.transform(spans, lambda s: F.when(is_term(s), far).otherwise(s["start"]))), F.least))
    return let(ends, lambda e: let(starts, lambda n: F.filter(spans, lambda s, i: ~is_term(s) | ((F.get(e, i) <= s["start"]) & (F.get(n, i) >= s["end"])))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as one string."""
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, PATTERNS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def sanitise(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``find``'s rows without ``spans``, their texts rewritten: entities become [EMAIL], [IP], [CARD] or [PHONE],
    generalised terms [TERM], removed terms nothing. Of overlapping spans the first is replaced. Texts without
    a span stay as they are, null included."""
    empty = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>)")
    tag = lambda s: F.when(s["value"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    kept = found.withColumn("_apart", F.when(F.size("spans") > 0, let(F.col("spans"), lambda s: first_of_overlaps(s))).otherwise(empty))
    end = lambda i: F.coalesce(F.get("_apart", i)["end"], F.lit(0).cast("long"))
    size = F.length(text_col).cast("long")
    changed = let(blocks_of(F.col(text_col)), lambda b: F.concat(
        F.array_join(F.transform("_apart", lambda s, i: F.concat(cut(b, end(i - 1), s["start"]), tag(s))), ""), cut(b, end(F.size("_apart") - 1), size)))
    return kept.withColumn(text_col, F.when(F.size("_apart") > 0, changed).otherwise(F.col(text_col))).drop("spans", "_apart")


def first_of_overlaps(spans: Column, part: int = 256) -> Column:
    """Sorted spans without those that begin inside the last one kept before them; walked in parts, as in ``scan``."""
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"
    none, nothing = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")
    state = lambda end, out: F.struct(end.alias("end"), out.alias("out"))
    keep = lambda acc, s: F.when(s["start"] >= acc["end"], state(s["end"], F.concat(acc["out"], F.array(s)))).otherwise(acc)
    walk = lambda acc, p: let(F.aggregate(p, state(acc["end"], none), keep), lambda r: state(r["end"], F.concat(acc["out"], F.array(r["out"]))))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / part).cast("int")), lambda c: F.slice(spans, c * part + 1, part))
    return F.flatten(F.aggregate(cuts, state(F.lit(0).cast("long"), nothing), walk)["out"])
