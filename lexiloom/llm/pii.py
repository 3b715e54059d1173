"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal what they found.

Patterns find the protected entities. For each entity the corpus tells how far a term of its lines gives it away: with
lines as events, the pointwise mutual information of term and entity as a share of the entity's own information,
``log(c N / (f_t f_e)) / log(N / f_e)``: 1 if the term never occurs without it. Terms over ``threshold`` are
generalised wherever they occur, those over ``removal`` are removed. All of it runs as Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, scratch, whole_text

KINDS = ["email", "ip", "card", "phone"]
#: Fixed values of the contract, with guards that spare the scanner hopeless starts: inside a run of local-part
#: characters or digits no match begins, but where the last one ended; and only whole digit runs of 16 to 19 are cards.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
SPANS = "array<struct<kind: string, start: int, stop: int, value: string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """digits: reversed here, every second one doubled, the sum a multiple of ten."""
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substring(back, i, 1).cast("int")).otherwise((F.substring(back, i, 1).cast("int") * 2) % 10 + F.floor(F.substring(back, i, 1).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": lambda m: _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def located(text: Column, pattern: Column, kind: str, block: int = 256) -> Column:
    """All matches of ``pattern`` from left to right, as spans of code points: the gaps between them give the places.

    Spans are gathered in blocks of ``block`` matches, so that a text with very many costs little more for each.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("value")))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, block))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        stop = first + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), first.alias("start"), stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def whole(acc: Column, cut: Column) -> Column:
        at = F.coalesce(F.get(acc, F.size(acc) - 1)["at"], F.lit(0))
        return F.concat(acc, F.array(F.aggregate(cut, F.struct(at.alias("at"), none.alias("spans")), step)))

    blocks = F.aggregate(cuts, F.array().cast(f"array<struct<at: int, spans: {SPANS}>>"), whole)
    return F.when(F.size(found) > 0, F.flatten(F.transform(blocks, lambda b: b["spans"]))).otherwise(none)


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind; failing ones are dropped without another try."""
    found = F.filter(located(text, F.lit(PATTERNS[kind]), kind), lambda s: VALID[kind](s["value"]))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast(SPANS))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def terms(text: Column) -> Column:
    """Distinct lower-cased words of letters and digits, of any length: names, numbers, tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def letters(line: Column) -> Column:
    """A hash of the line's words of letters, in their order and without case."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " ")))


def entity(kind: Column, value: Column) -> Column:
    """What counts as one protected entity: the kind and the value without case and separators."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), F.regexp_replace(value, r"[^0-9]", "")).otherwise(F.lower(value)))


def detect(docs: DataFrame) -> DataFrame:
    """``row, doc`` (all columns of ``docs`` as they are) and the spans of each kind, written once."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), whole_text().alias("text"))
    found = found.select(F.monotonically_increasing_id().alias("row"), "doc", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    return materialise(found, "personal").withColumn("text", F.coalesce("doc.text", F.lit("")))


def disclosing(found: DataFrame, *, threshold: float = 0.8, removal: float = 0.95, support: int = 3, distinct: bool = False) -> DataFrame:
    """``term, share, removed``: the terms that reveal an entity of ``found``, the result of detect().

    A term needs ``support`` different contexts of the same entity, none of them over half of its lines, so that copies
    and near copies of one line prove nothing; a context is the words next to the entity on either side. Counts run
    over all lines of all documents.

    ``distinct``: each distinct line counts once instead (lines that differ only in case and in what isn't a letter are
    one), and a term needs ``support`` of an entity's, whatever stands next to it. Copies then add and hide nothing.
    """
    with scratch(found.sparkSession, "disclosing") as lasting:
        spans = F.explode(F.concat(*KINDS)).alias("s")
        here = found.filter(F.size(F.concat(*KINDS)) > 0).select("row", "text", spans)
        before = F.substring_index(F.expr("left(text, s.start)"), "\n", -1)
        after = F.substring_index(F.expr("substring(text, s.stop + 1)"), "\n", 1)
        number = F.size(F.split(F.expr("left(text, s.start)"), "\n"))
        mentions = here.select("row", number.alias("number"), entity(F.col("s.kind"), F.col("s.value")).alias("entity"), "s.start", before.alias("before"), after.alias("after"))
        # a line that has an entity twice is one line
        mentions = mentions.groupBy("row", "number", "entity").agg(F.min_by("before", "start").alias("before"), F.min_by("after", "start").alias("after"))
        context = F.xxhash64(F.substring_index(F.rtrim("before"), " ", -1), F.substring_index(F.ltrim("after"), " ", 1))
        line = F.regexp_replace(F.concat_ws(" ", "before", "after"), PATTERNS["email"], " ")
        if distinct:
            mentions = mentions.select("entity", line.alias("line")).groupBy("entity", letters(F.col("line")).alias("context")).agg(F.min("line").alias("line")).withColumn("n", F.lit(1).cast("long"))
            mentions = materialise(mentions, "mentions")
        else:
            mentions = materialise(mentions.groupBy("entity", context.alias("context"), line.alias("line")).agg(F.count("*").alias("n")), "mentions")
        contexts = mentions.groupBy("entity", "context").agg(F.sum("n").alias("n"))
        entities = contexts.groupBy("entity").agg(F.sum("n").alias("fe"), F.count("*").alias("contexts")).filter(F.col("contexts") >= support)
        entities = materialise(entities, "entities")
        pairs = mentions.join(entities, "entity").select("entity", "fe", "n", "context", F.explode(terms(F.col("line"))).alias("term"))
        pairs = pairs.groupBy("entity", "term", "fe", "context").agg(F.sum("n").alias("n"))
        pairs = pairs.groupBy("entity", "term", "fe").agg(F.sum("n").alias("c"), F.count("*").alias("met"), F.max("n").alias("most"))
        pairs = pairs.filter((F.col("met") >= support) & (F.lit(distinct) | (F.col("most") * 2 <= F.col("c"))))
        pairs = materialise(pairs, "pairs")
        wanted = materialise(pairs.select("term").distinct(), "terms")
        lines = found.select(F.explode(F.split("text", "\n")).alias("line"))
        total = found.agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))
        if distinct:
            lines = materialise(lines.groupBy(letters(F.col("line")).alias("context")).agg(F.min("line").alias("line")).select("line"), "lines")
            total = lines.agg(F.count("*").alias("lines"))
        often = lines.select(F.explode(terms(F.col("line"))).alias("term")).groupBy("term").agg(F.count("*").alias("ft")).join(wanted, "term")
        share = F.ln(F.col("c") * F.col("lines") / (F.col("ft") * F.col("fe"))) / F.ln(F.col("lines") / F.col("fe"))
        # one row of totals
        scored = pairs.join(often, "term").crossJoin(F.broadcast(total)).select("term", F.when(F.col("lines") > F.col("fe"), share).otherwise(0.0).alias("share"))
        best = scored.groupBy("term").agg(F.max("share").alias("share")).filter(F.col("share") >= threshold)
        return lasting(best.select("term", "share", (F.col("share") >= removal).alias("removed")), "disclosing")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced, from left to right; what overlaps an earlier span goes with it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        name = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, name)).otherwise(acc["out"]).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` in the struct ``doc``, with ``text``, the spans ``email, ip, card, phone, term`` and ``sanitised``.

    Every row of ``docs`` (doc_id, text and any others) comes back once. A null text is empty and has no spans, as has
    an empty one; null and repeated doc_ids stay; an empty table gives no rows. Spans count code points, ends
    exclusive. Terms have the kind ``term`` if generalised and ``removed`` if removed, and follow the four kinds.
    """
    found = detect(docs)
    said = disclosing(found, **limits)
    words = found.select("row", F.explode(terms(F.col("text"))).alias("term"))
    hits = words.join(said, "term").groupBy("row", "removed").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("any"))
    hits = hits.groupBy("row").agg(*[F.max(F.when(F.col("removed") == r, F.col("any"))).alias(n) for r, n in ((False, "general"), (True, "gone"))])
    out = found.join(materialise(hits, "hits"), "row", "left")

    def spans_of(any_: str, kind: str) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.col(any_), F.lit(r")(?![\p{L}\p{N}])"))
        return F.when(F.col(any_).isNotNull(), located(F.col("text"), pattern, kind)).otherwise(F.array().cast(SPANS))

    out = out.withColumn("term", F.array_sort(F.concat(spans_of("general", "term"), spans_of("gone", "removed")), lambda a, b: a["start"] - b["start"]))
    out = out.withColumn("all", F.concat(*KINDS, "term"))
    clear = F.when(F.size("all") > 0, sanitised(F.col("text"), F.col("all"))).otherwise(F.col("text"))
    return out.select("doc", "text", *KINDS, "term", "all", clear.alias("sanitised"))


def report(docs: DataFrame, **limits) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row, and n_term; see sanitise()."""
    out = sanitise(docs.select("doc_id", "text"), **limits)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in [*KINDS, "term"]]
    base = F.sha2(written(F.concat(*KINDS)), 256)
    return out.select("doc.doc_id", *counts[:4], base.alias("base_sha256"), written(F.col("all")).alias("spans"), counts[4])


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` with their texts sanitised and n_chars, where there is one, counted anew; nulls stay."""
    out = sanitise(docs, **limits)
    fresh = {"text": F.when(F.col("doc.text").isNotNull(), F.col("sanitised")), "n_chars": F.length(F.when(F.col("doc.text").isNotNull(), F.col("sanitised"))).cast("long")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


#: Fixed values of the contract.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def _located_sql(kind: str) -> str:
    """kind, start, stop, value of each valid match, from the contract's own pattern."""
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * reverse({digits})[i]::INT) % 10 + (CASE WHEN i % 2 = 0 AND reverse({digits})[i]::INT > 4 THEN 1 ELSE 0 END))) % 10 = 0"
    valid = {"email": "true", "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda x: x::HUGEINT <= 255))", "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15"}
    return f"""SELECT row, '{kind}' AS kind, {KINDS.index(kind)} AS place, start::BIGINT AS start, start::BIGINT + length(value) AS stop, value FROM
        (SELECT row, m[i] AS value, coalesce(list_sum(list_transform(g[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT row, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT row, regexp_extract_all(text, '{PLAIN[kind]}') AS m, regexp_split_to_array(text, '{PLAIN[kind]}') AS g FROM d))) WHERE {valid[kind]}"""


def oracle(threshold: float = 0.8, removal: float = 0.95, support: int = 3) -> str:
    """report() in DuckDB SQL."""
    terms_of = lambda x: f"unnest(list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({" UNION ALL ".join(_located_sql(k) for k in KINDS)}),
    every AS (SELECT row, start, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(value) END AS entity,
        len(string_split(substr(text, 1, start), chr(10))) AS number, string_split(substr(text, 1, start), chr(10))[-1] AS before, string_split(substr(text, stop + 1), chr(10))[1] AS after FROM spans JOIN d USING (row)),
    sides AS (SELECT row, number, entity, arg_min(before, start) AS before, arg_min(after, start) AS after FROM every GROUP BY 1, 2, 3),
    mentions AS (SELECT entity, string_split(rtrim(before), ' ')[-1] || chr(0) || string_split(ltrim(after), ' ')[1] AS context, regexp_replace(before || ' ' || after, '{PLAIN["email"]}', ' ', 'g') AS line, count(*) AS n FROM sides GROUP BY ALL),
    entities AS (SELECT entity, sum(n) AS fe FROM mentions GROUP BY 1 HAVING count(DISTINCT context) >= {support}),
    met AS (SELECT entity, term, fe, context, sum(n) AS n FROM (SELECT entity, fe, n, context, {terms_of("line")} AS term FROM mentions JOIN entities USING (entity)) GROUP BY ALL),
    pairs AS (SELECT entity, term, fe, sum(n) AS c FROM met GROUP BY 1, 2, 3 HAVING count(*) >= {support} AND max(n) * 2 <= sum(n)),
    lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM d),
    often AS (SELECT term, count(*) AS ft FROM (SELECT {terms_of("line")} AS term FROM lines) SEMI JOIN pairs USING (term) GROUP BY 1),
    said AS (SELECT term, max(CASE WHEN n > fe THEN ln(c * n / (ft * fe)) / ln(n / fe) ELSE 0 END) AS share FROM pairs JOIN often USING (term), (SELECT count(*)::DOUBLE AS n FROM lines) GROUP BY 1 HAVING share >= {threshold}),
    words AS (SELECT row, 1 + length(pre) AS start, w FROM (SELECT row, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS gs FROM d WHERE row IN (SELECT row FROM (SELECT row, {terms_of("text")} AS term FROM d) SEMI JOIN said USING (term)))
        , LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i), LATERAL (SELECT ws[i] AS w, array_to_string(list_concat(gs[1 : i], ws[1 : i - 1]), '') AS pre)),
    hits AS (SELECT row, CASE WHEN share >= {removal} THEN 'removed' ELSE 'term' END AS kind, 9 AS place, start - 1 AS start, start - 1 + length(w) AS stop FROM words JOIN said ON term = lower(w)),
    together AS (SELECT row, kind, place, start, stop FROM spans UNION ALL SELECT * FROM hits),
    per AS (SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (place = 9) AS n_term,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (place < 9), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS spans FROM together GROUP BY 1)
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term FROM d LEFT JOIN per USING (row)
    """
