"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. Their values are the protected
entities. A term ``t`` (a word of any length, lower-cased) that stands anywhere in a text that holds an entity ``c`` may reveal it; how
strongly is estimated from the whole corpus, in documents:

    P(c) = n(c) / N,   P(c | t) = (n'(t, c) + P(c)) / (n'(t) + 1),   PMI(t; c) = log2(P(c | t) / P(c)),   IC(c) = -log2(P(c)),   disclosure = PMI / IC.

The counts n' leave one text's documents out (of a pair's k texts, the share 1/k), and one document's weight goes to P(c): a text cannot testify
for itself, and few texts say less than many. Every occurrence, in the texts that hold the entity, of a term with a disclosure of ``remove`` or
more is removed, of ``generalise`` or more replaced by a general mark. Base spans always stay.

With a ``reach`` only terms of four letters or more within so many characters of an entity count and are
marked, by plain PMI, where at least ``support`` different texts show the pair; that discloses what stands farther away.

Everything is built-in SQL functions. Positions come from splitting a text at the same pattern that finds the matches:
lengths of pieces and matches add up. The patterns are linear on any text: quantifiers are possessive where the next
character decides, and a match only starts where a run of its characters starts.

Edge cases: a null text is empty; a very long text is looked through whole; a null id is kept; equal texts get equal spans (they are found once); pairs are counted by documents, copies and repeated
rows included, but borne out by different texts only; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
GATES = {"email": "@", "phone": "+"}
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{3,}+"
WORD = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]*+"
_OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_BLOCK = 256


def _before(lengths: Column) -> Column:
    """Sum of the lengths before each place. Blocks bound the copying of growing arrays."""

    def upto(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: upto(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    bases = F.slice(upto(F.transform(blocks, lambda x: F.element_at(x, -1))), 1, F.size(blocks))
    return F.flatten(F.zip_with(blocks, bases, lambda x, base: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + base)))


def _found(frame: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add, for each name, ``at_<name>``: array<struct<start,end,value>> of the matches in order. Matches, pieces and
    positions are separate projections, so that none is computed twice."""
    t = F.col(text)
    for name, p in patterns.items():
        gate = t.contains(GATES[name]) if name in GATES else t.isNotNull()
        frame = frame.withColumn(f"m_{name}", F.when(gate, F.regexp_extract_all(t, F.lit(p), F.lit(0))))
    for name, p in patterns.items():
        frame = frame.withColumn(f"p_{name}", F.when(F.size(f"m_{name}") > 0, F.transform(F.split(t, F.lit(p), F.lit(-1)), F.length)))
    for name in patterns:
        m, p = F.col(f"m_{name}"), F.col(f"p_{name}")
        # a lambda must not name a column that is still to be computed: it would be computed for every element
        steps = F.concat(F.array(F.element_at(p, 1)), F.zip_with(m, F.slice(p, 2, F.size(m)), lambda a, b: F.length(a) + b))
        frame = frame.withColumn(f"s_{name}", F.when(F.size(m) > 0, F.slice(_before(steps), 2, F.size(m))))
    for name in patterns:
        spans = F.zip_with(f"m_{name}", f"s_{name}", lambda v, s: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))
        frame = frame.withColumn(f"at_{name}", F.when(F.size(f"m_{name}") > 0, spans))
    return frame.drop(*(f"{x}_{name}" for name in patterns for x in "mps"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 20 digits passes: from the right, every second digit is doubled and cast out by nines."""
    padded = F.substr(F.concat(F.lit("0" * 20), digits), F.length(digits) + 1, F.lit(20))
    doubled = F.translate(padded, "0123456789", "0246813579")
    one = lambda s, i: F.substr(s, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(19), F.lit(2)), F.lit(0), lambda a, i: a + one(doubled, i) + one(padded, i + 1)) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def base_spans(frame: DataFrame, text: str) -> DataFrame:
    """Add ``base``: array<struct<start,rank,end,kind,value>> by start, then kind."""
    frame = _found(frame, text, PATTERNS)

    def kept(rank: int, kind: str) -> Column:
        good = F.filter(F.col(f"at_{kind}"), lambda x: VALID[kind](x["value"]))
        made = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
        return F.coalesce(made, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>"))

    parts = [kept(rank, kind) for rank, kind in enumerate(PATTERNS)]
    return frame.withColumn("base", F.array_sort(F.concat(*parts))).drop(*(f"at_{k}" for k in PATTERNS))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _entity(span: Column) -> Column:
    """A base span's value without its layout: lower case, and digits only where the kind is a number."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def contexts(found: DataFrame, reach: int) -> DataFrame:
    """One row per text and base span, text columns ``left`` and ``right``, from (key, text, base)."""
    spans = found.where(F.size("base") > 0).select("key", "text", F.explode("base").alias("b"))
    start, end = F.col("b.start"), F.col("b.end")
    left = F.substr("text", F.greatest(start - reach + 1, F.lit(1)), F.least(start, F.lit(reach)))
    cut = F.length("text") > end + reach
    return spans.select("key", _entity(F.col("b")).alias("entity"), left.alias("left"), F.greatest(start - reach, F.lit(0)).alias("offset"), F.substr("text", end + 1, F.lit(reach)).alias("right"), end.alias("end"), cut.alias("cut"))


def _terms(windows: DataFrame) -> DataFrame:
    """Whole terms in the windows: key, entity, term, start, end."""
    sides = windows.select("key", "entity", F.explode(F.array(F.struct(F.col("left").alias("side"), F.col("offset").alias("from"), (F.col("offset") > 0).alias("open"), F.lit(False).alias("cut")), F.struct(F.col("right").alias("side"), F.col("end").alias("from"), F.lit(False).alias("open"), F.col("cut").alias("cut")))).alias("w")).select("key", "entity", "w.*")
    found = _found(sides, "side", {"term": TERM}).withColumn("width", F.length("side")).select("key", "entity", "from", "open", "cut", "width", F.explode("at_term").alias("t"))
    # a term at a window's open edge may be the rest of a longer one
    whole = found.where(~(F.col("open") & (F.col("t.start") == 0)) & ~(F.col("cut") & (F.col("t.end") == F.col("width"))))
    return whole.select("key", "entity", F.lower("t.value").alias("term"), (F.col("from") + F.col("t.start")).alias("start"), (F.col("from") + F.col("t.end")).alias("end"))


def document_frequency(docs: DataFrame, term: str = TERM) -> DataFrame:
    """Number of documents with each term, over all documents; summed before the shuffle."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(term), F.lit(0)), F.lower))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def revealing_terms(docs: DataFrame, terms: DataFrame, weights: DataFrame, *, support: int, generalise: float, remove: float) -> DataFrame:
    """Pairs (entity, term) over the thresholds, with ``kind``. ``weights``: documents per text key."""
    pairs = terms.select("key", "entity", "term").distinct().join(weights, "key")
    together = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("n_tc"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    entities = pairs.select("key", "entity", "rows").distinct().groupBy("entity").agg(F.sum("rows").alias("n_c"))
    total = docs.agg(F.count("*").alias("n"))
    rated = together.join(document_frequency(docs), "term").join(entities, "entity").crossJoin(F.broadcast(total))  # one row
    pmi = F.log2(F.col("n") * F.col("n_tc") / (F.col("n_t") * F.col("n_c")))
    content = F.log2(F.col("n") / F.col("n_c"))
    disclosure = F.when(content > 0, pmi / content)
    kind = F.when(disclosure >= remove, F.lit("remove")).when(disclosure >= generalise, F.lit("generalise"))
    return rated.select("entity", "term", kind.alias("kind")).where("kind is not null")


def _whole(docs: DataFrame, found: DataFrame, generalise: float, remove: float) -> DataFrame:
    """Places (key, start, end, kind) of the terms over the thresholds, in whole texts, from (key, text, base)."""
    held = found.where(F.size("base") > 0).groupBy("key").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("rows"))
    held = _found(held, "text", {"term": WORD})
    places = F.transform("at_term", lambda x: F.struct(F.lower(x["value"]).alias("term"), x["start"].alias("start"), x["end"].alias("end")))
    held = held.select("key", "rows", F.array_distinct(F.transform("base", _entity)).alias("entities"), places.alias("places")).checkpoint()
    by_entity = held.select("key", "rows", F.explode("entities").alias("entity"))
    # with one text left out, an entity or pair of one text has no witness: its disclosure is 0 at most
    entities = by_entity.groupBy("entity").agg(F.sum("rows").alias("n_c"), F.count("*").alias("texts")).where("texts > 1").select("entity", "n_c").checkpoint()
    shared = by_entity.join(entities, "entity").groupBy("key").agg(F.collect_set("entity").alias("entities"))
    few = held.drop("entities").join(shared, "key").checkpoint()
    pairs = few.select("key", "rows", F.explode("entities").alias("entity"), F.array_distinct("places.term").alias("terms")).select("key", "rows", "entity", F.explode("terms").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("n_tc"), F.count("*").alias("texts")).where("texts > 1")
    total = docs.agg(F.count("*").alias("n"))
    rated = together.join(document_frequency(docs, WORD), "term").join(entities, "entity").crossJoin(F.broadcast(total))  # one row
    own, chance = F.col("n_tc") / F.col("texts"), F.col("n_c") / F.col("n")
    given = (F.col("n_tc") - own + chance) / (F.col("n_t") - own + 1)
    disclosure = F.when(chance < 1, F.log2(given / chance) / -F.log2(chance))
    kind = F.when(disclosure >= remove, F.lit("remove")).when(disclosure >= generalise, F.lit("generalise"))
    known = rated.select("entity", "term", kind.alias("kind")).where("kind is not null").checkpoint()
    kinds = pairs.join(known, ["entity", "term"]).groupBy("key", "term").agg(F.max("kind").alias("kind"))
    at = few.select("key", F.explode("places").alias("p")).select("key", "p.*")
    return at.join(kinds, ["key", "term"]).select("key", "start", "end", "kind")


def detect(docs: DataFrame, *, reach: int | None = None, support: int = 2, generalise: float = 0.75, remove: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(rows with their base spans: all columns of ``docs`` but the text under ``row``, key, base; term spans by key)."""
    d = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text", text_key(F.col("text")).alias("key"))
    found = base_spans(d, "text")
    base = found.select("row", "key", "base")
    if reach is None:
        flagged = _whole(docs.select("text"), found.select("key", "text", "base"), generalise, remove)
    else:
        held = contexts(found.select("key", "text", "base"), reach).groupBy("key").agg(F.collect_set(F.struct("entity", "left", "offset", "right", "end", "cut")).alias("w"), F.count("*").alias("seen"))
        # copies add up to ``seen``: as many contexts as the text has, times its documents
        held = held.select("key", (F.col("seen") / F.size("w")).cast("long").alias("rows"), "w").checkpoint()
        terms = _terms(held.select("key", F.explode("w").alias("w")).select("key", "w.*"))
        known = revealing_terms(docs.select("text"), terms, held.select("key", "rows"), support=support, generalise=generalise, remove=remove)
        flagged = terms.join(known, ["entity", "term"]).groupBy("key", "start", "end").agg(F.max("kind").alias("kind"))
    rank = F.when(F.col("kind") == "remove", KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    spans = flagged.groupBy("key").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", F.lit("").alias("value"))).alias("more"))
    # written down, so that the rows of a text that very many documents have can be dealt out where they meet its spans
    return base, spans.checkpoint()


def _all_spans(base: Column, more: Column) -> Column:
    clear = F.filter(F.coalesce(more, F.slice(base, 1, 0)), lambda x: ~F.exists(base, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return F.array_sort(F.concat(base, clear))


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, *, reach: int | None = None, **options) -> DataFrame:
    """Per document: its columns but the text, n_email, n_ip, n_card, n_phone, base_sha256 and spans; of whole texts, unless ``reach`` is given."""
    base, more = detect(docs, reach=reach, **options)
    both = base.join(more, "key", "left")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in PATTERNS]
    return both.select("row.*", *counts, F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(_all_spans(F.col("base"), F.col("more"))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's mark; spans that overlap are one, of the first one's kind."""
    table = F.create_map(*(F.lit(v) for pair in MARKS.items() for v in pair))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        before = F.substr(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        out = F.when(x["start"] >= a["at"], F.concat(a["out"], before, F.element_at(table, x["kind"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the spans of every text replaced; n_chars, where there is such a column, follows. A null text stays null."""
    _, more = detect(docs, **options)
    d = docs.select(F.struct(*docs.columns).alias("row"), "text", text_key(F.col("text")).alias("key"))
    both = base_spans(d, "text").join(more, "key", "left")
    both = both.select("row", "text", _all_spans(F.col("base"), F.col("more")).alias("spans"))
    new = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    both = both.select("row", new.alias("new"))
    made = {"text": F.col("new"), "n_chars": F.when(F.col("new").isNotNull(), F.length("new").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return both.select(*((made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
