"""Information-theoretic sanitisation, DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. They are the protected entities. A term (word of three or
more letters or digits outside base spans) that stands in the documents of an entity may reveal it: over the whole corpus, with N documents,
PMI(t; e) = log(N n_te / (n_t n_e)) measures how much the term says about the entity, and IC(e) = log(N / n_e) is all there is to
say; n_te, n_t and n_e count documents. The disclosure of a term is its largest PMI / IC over the entities that it stands with
in at least MIN_TEXTS different texts. Terms that reach GENERALISE are generalised to their kind (<name>, <number>, <term>), those
that reach REMOVE are removed, wherever they stand.

Work: one pass finds base spans and the words of the documents that hold one; one pass counts the documents of every word
(aggregated before the shuffle); pairs are made of entities in MIN_TEXTS texts and words no more frequent than the threshold
allows for that entity, once per different text, and aggregated before the shuffle; one pass looks up the flagged terms; a join
marks the texts. All counts cover all documents and whole texts.

Defined cases: a null text is an empty one; empty texts have no spans; repeated rows give one row each; an entity that is in every
document has nothing left to reveal and flags no term; copies of one text count as one text for MIN_TEXTS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netledger.llm.storage import stage

GENERALISE, REMOVE = 0.8, 0.95
MIN_TEXTS = 3
#: Share of all documents from which a word counts as frequent.
FREQUENT = 0.01
KINDS = ("email", "ip", "card", "phone")
_WORD = r"[\p{L}\p{N}]"
# Written so that long runs are scanned once: a match can only begin where its run begins or the last match ended.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (and its digits added), is a multiple of 10."""
    n = F.length(digits)
    weigh = lambda i: F.when(i % 2 == 0, F.substr(digits, n - i, F.lit(1)).cast("int")).otherwise(
        F.substr(digits, n - i, F.lit(1)).cast("int") * 2
    )
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: weigh(i) - F.when(weigh(i) > 9, 9).otherwise(0))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda span: _valid(kind, span["value"])


def _placed(text: Column, pattern: Column, found: Column, kind: str, rank: int) -> Column:
    """Spans of the matches: what lies between them comes from splitting at the same pattern."""
    empty = F.array().cast(f"array<{_SPAN}>")
    gaps = F.split(text, pattern, -1)

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
                        piece["hit"].alias("value"))
        return F.struct(
            F.coalesce(end, start).cast("int").alias("at"),
            F.when(piece["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span.cast(_SPAN)))).alias("out"),
        )

    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(pieces, start, step)["out"]).otherwise(empty)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), base: array of (start, rank, end, kind, value) by start, then kind as listed."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    needs = {"email": "@", "phone": "+"}
    for kind in KINDS:
        found = F.regexp_extract_all("text", F.lit(_PATTERNS[kind]), F.lit(0))
        if kind in needs:
            found = F.when(F.instr("text", needs[kind]) > 0, found).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(f"found_{kind}", found)
    for rank, kind in enumerate(KINDS):
        placed = _placed(F.col("text"), F.lit(_PATTERNS[kind]), F.col(f"found_{kind}"), kind, rank)
        rows = rows.withColumn(f"spans_{kind}", F.filter(placed, _checked(kind)))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*[f"spans_{k}" for k in KINDS])).alias("base"))


def _outside(text: Column, base: Column) -> Column:
    """The text without its base spans, a space for each."""
    def step(state: Column, s: Column) -> Column:
        cut = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).cast("int").alias("at"),
                        F.concat(state["parts"], F.array(cut)).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda state: F.concat(F.array_join(state["parts"], " "), F.lit(" "), F.substr(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(base, start, step, rest))


def _words(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def seen_entities(docs: DataFrame) -> DataFrame:
    """text_key, entities and, where there are any, words per document."""
    base = F.col("base")
    return stage(
        with_base_spans(docs.select(docs["doc_id"], docs["text"])).select(
            F.unhex(F.md5("text")).alias("text_key"), F.array_distinct(F.transform(base, _entity)).alias("entities"),
            F.when(F.size(base) > 0, _words(_outside(F.col("text"), base))).alias("words"),
        ), "seen",
    )


def disclosing_terms(seen: DataFrame, docs: DataFrame, generalise: float = GENERALISE, min_texts: int = MIN_TEXTS,
                     ) -> tuple[DataFrame, DataFrame]:
    """(terms, places): term and disclosure of each flagged term; text_key and term for the texts that hold one.

    seen: what seen_entities gives; docs: the texts.
    """
    n = seen.count()
    total = F.lit(float(max(n, 1)))
    # Documents, not occurrences: a document that names an entity twice counts once.
    held = stage(
        seen.select("text_key", F.explode("entities").alias("entity"))
        .groupBy("entity", "text_key").agg(F.count("*").alias("docs")), "held",
    )
    # n_te is at most n_e, so PMI / IC >= generalise needs n_t <= n_e (N / n_e)^(1 - generalise): an exact bound per entity.
    most = F.col("n_e") * F.pow(total / F.col("n_e"), F.lit(1.0 - generalise)) * (1 + 1e-9)
    entities = (
        held.groupBy("entity").agg(F.sum("docs").alias("n_e"), F.count("*").alias("texts"))
        .filter((F.col("texts") >= min_texts) & (F.col("n_e") < n)).select("entity", "n_e", most.alias("most"))
    )
    holders = stage(held.join(entities, "entity"), "holders")
    limit = holders.agg(F.max("most")).first()[0] or 0.0
    words = docs.select(
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), F.explode(_words(F.col("text"))).alias("term"))
    spread = with_base_spans(docs.select(docs["doc_id"], docs["text"])).select(
        F.explode(_words(_outside(F.col("text"), F.col("base")))).alias("term"))
    counted = stage(spread.groupBy("term").agg(F.count("*").alias("n_t")).filter(F.col("n_t") >= min_texts), "counted")
    # Words too frequent for any entity and in FREQUENT of the documents: their number is at most the mean number of words of a
    # document / FREQUENT, however many documents there are. They leave before anything is shuffled by term.
    frequent = counted.filter(F.col("n_t") > max(limit, FREQUENT * n)).select("term")
    beside = (
        seen.filter(F.size("entities") > 0).select("text_key", F.explode("words").alias("term"))
        .join(F.broadcast(frequent), "term", "left_anti")
        .join(counted.filter(F.col("n_t") <= limit), "term").groupBy("text_key", "term").agg(F.max("n_t").alias("n_t"))
    )
    pairs = (
        holders.join(beside, (holders["text_key"] == beside["text_key"]) & (beside["n_t"] <= holders["most"]))
        .groupBy("entity", "term").agg(
            F.sum("docs").alias("n_te"), F.count("*").alias("texts"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e"))
        .filter(F.col("texts") >= min_texts)
    )
    disclosure = F.log(total * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(total / F.col("n_e"))
    terms = stage(
        pairs.groupBy("term").agg(F.max(disclosure).alias("disclosure")).filter(F.col("disclosure") >= generalise), "terms")
    return terms, words.join(terms.select("term"), "term", "left_semi")


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """row (the columns of docs but text), absent (text was null), text, base_spans and all_spans (base and term spans) per row.

    Spans are structs (start, rank, end, kind, value, action); term spans that touch a base span are left out.
    """
    columns = docs.columns
    key = "text_key_of_pii_"
    seen = seen_entities(docs)
    terms, places = disclosing_terms(seen, docs, generalise, min_texts)
    marks = stage(
        places.distinct().join(terms, "term").groupBy("text_key").agg(
            F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("marked_terms_")
        ), "marks",
    )
    # A merge join at every size: the marks grow with the corpus, so texts are dealt by key, each carried once and before its spans.
    rows = docs.select(
        F.struct(*[docs[c] for c in columns if c != "text"]).alias("row"), docs["text"].alias("text"),
        F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias(key),
    ).join(marks.withColumnRenamed("text_key", key).hint("merge"), key, "left")
    rows = with_base_spans(rows.select(F.struct("row", F.col("text").isNull().alias("absent"), "marked_terms_").alias("doc_id"), "text"))
    rows = rows.select("doc_id.*", "text", "base")
    plain = F.coalesce(F.map_keys("marked_terms_"), F.array().cast("array<string>"))
    # Terms are letters and digits only, so they need no quoting; (?iu) because texts keep their case.
    pattern = F.concat(F.lit(rf"(?iu)(?<!{_WORD})(?:"), F.array_join(plain, "|"), F.lit(rf")(?!{_WORD})"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("pattern_", pattern).withColumn(
        "found_term", F.when(F.size(plain) > 0, F.regexp_extract_all("text", F.col("pattern_"), F.lit(0))).otherwise(none)
    )
    rows = rows.withColumn("spans_term", _placed(F.col("text"), F.col("pattern_"), F.col("found_term"), "term", len(KINDS)))
    act = lambda s, action: F.struct(*[s[f] for f in ("start", "rank", "end", "kind", "value")], action.alias("action"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    strength = lambda s: F.coalesce(F.element_at("marked_terms_", F.lower(s["value"])), F.lit(0.0))
    base = F.transform("base", lambda s: act(s, F.lit("generalise")))
    added = F.transform(
        F.filter("spans_term", free),
        lambda s: act(s, F.when(strength(s) >= remove, F.lit("remove")).otherwise(F.lit("generalise"))),
    )
    return rows.select(
        "row", "absent", "text", base.alias("base_spans"), F.array_sort(F.concat(base, added)).alias("all_spans")
    )


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms per document row."""
    found = find(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "row.doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"),
        span_text(F.col("all_spans")).alias("spans"),
        (F.size("all_spans") - F.size("base_spans")).cast("bigint").alias("n_terms"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """The same rows and columns with the spans rewritten in text (and n_chars, where there is one, brought up to date).

    Entities become <email>, <ip>, <card>, <phone>; terms are generalised to <name> (capitalised), <number> (digits only) or
    <term>, or removed. Of overlapping spans the one that starts first (then the first kind) wins; the rest of the other one
    is dropped with it. A null text stays null.
    """
    found = find(docs)
    general = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("<"), s["kind"], F.lit(">"))).when(
        s["action"] == "remove", F.lit("")
    ).when(s["value"].rlike(r"^\p{N}+$"), F.lit("<number>")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("<name>")).otherwise(
        F.lit("<term>")
    )

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        cut = F.substr(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], s["end"]).cast("int").alias("at"),
            F.when(fresh, F.concat(state["parts"], F.array(cut, general(s)))).otherwise(state["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    folded = found.withColumn("state", F.aggregate("all_spans", start, step))
    rest = F.substr(F.col("text"), F.col("state.at") + 1, F.length("text"))
    text = F.when(F.size("all_spans") == 0, F.col("text")).otherwise(
        F.concat(F.array_join("state.parts", ""), rest)
    )
    folded = folded.withColumn("new_text", F.when(F.col("absent"), F.lit(None)).otherwise(text))
    replaced = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType)
                if "n_chars" in docs.columns else None}
    return folded.select(*[
        (replaced[c] if replaced.get(c) is not None else F.col("row").getField(c)).alias(c) for c in docs.columns
    ])
