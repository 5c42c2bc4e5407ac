"""Personal data: fixed patterns, and terms whose co-occurrence with an entity discloses it.  Only built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, stored, table, unpacked
from .spans import digest, kind_spans, matches, written

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns.  Where a match could only start at the start of a run, or where the last match ended, no
# other place is tried: the same matches in linear time.  Possessive groups keep Java from recursing over long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Terms are letters, so many at least.
TERM_LEAST = 3
#: A term discloses an entity if the mutual information of the two is this share of the entity's information, and if they
#: meet in so many documents.  One meeting tells nothing: every word that only one document has would disclose each entity in it.
#: Two of a term and an entity this rare are no chance: of n documents two given ones hold both in one of n * (n - 1) / 2 ways.
DISCLOSURE, SUPPORT = 0.9, 2
#: Rounding that the bounds below allow for.
SLACK = 1e-9
#: Rows, and terms in all of a row's list, that may be broadcast, after they have been counted.
BROADCAST_ROWS, BROADCAST_TERMS = 100_000, 500_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def base(text: Column) -> dict[str, Column]:
    """The base spans of each kind; text must not be null."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    has = lambda c, spans: F.when(F.contains(text, F.lit(c)), spans).otherwise(empty)
    length = lambda s: F.length(_digits(s["value"]))
    return {
        "email": has("@", matches(text, EMAIL)),
        "ip": F.filter(matches(text, IP), lambda s: s["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        "card": F.filter(matches(text, CARD), lambda s: F.when(length(s) <= 19, _luhn(s["value"])).otherwise(F.lit(False))),
        "phone": F.filter(has("+", matches(text, PHONE)), lambda s: length(s).between(9, 15)),
    }


def _base_row(text: Column) -> Column:
    found = base(text)
    return F.struct(*(found[k].alias(k) for k in KINDS[:4]))


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df written once, broadcast if it has few rows, and its number of rows."""
    kept = stored(df, "pii")
    rows = kept.count()
    return (F.broadcast(kept) if rows <= BROADCAST_ROWS else kept), rows


def _distinct_terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\P{L}+")), lambda t: F.length(t) >= TERM_LEAST)


def _terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term) for every distinct term of every whole text."""
    return docs.select("doc_id", F.explode(_distinct_terms(F.col("text"))).alias("term"))


def disclosing(docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure): terms that tell of an entity more than DISCLOSURE allows.

    docs: (doc_id, text), no nulls in text.  Documents are counted over the whole corpus: how many hold the entity, the term,
    and both, wherever in the text.  The pointwise mutual information of the last against the first two, as a share of the
    entity's own information -log p(entity), is 1 if the term never occurs without the entity and 0 if it tells nothing.
    Rows count as documents, copies of a text and null ids too.  A hot term or entity costs a count for each task, not a row
    for each document.  Before pairs are made, only what cannot reach the share or SUPPORT is left out.
    """
    rows = _with_entities(docs)
    each = stored(rows.select("entities", _distinct_terms(F.col("text")).alias("terms")), "pii-rows")
    n = docs.count()
    # Two meet in no more documents than the entity has, so that one in fewer than SUPPORT has no pair.
    entities, n_entities = _counted(each.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT))
    # A term occurs in as many documents at least as it does beside entities, and meets one in n_e or n_t at most.
    beside = each.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= SUPPORT)
    most = entities.agg(F.max("n_e")).first()[0] if n_entities else 0
    best = _share(n, F.least("n_e", "n_t")) >= DISCLOSURE - SLACK
    beside, _ = _counted(beside.withColumn("n_e", F.lit(most).cast("long")).where(best | (F.col("n_t") <= F.col("n_e"))).drop("n_e"))
    held = each.select("terms", F.explode("entities").alias("entity")).join(entities, "entity").select("entity", "n_e", F.explode("terms").alias("term"))
    met = held.join(beside, "term").where(best).groupBy("entity", "term").agg(F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t"), F.count("*").alias("n_et"))
    likely = met.where((F.col("n_et") >= SUPPORT) & (_share(n) >= DISCLOSURE - SLACK)).drop("n_t")
    pairs = stored(likely, "pii-pairs")
    wanted, n_terms = _counted(pairs.select("term").distinct())
    if not n_terms:
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    counts = _terms(docs).join(wanted, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    return pairs.join(counts, "term").select("entity", "term", _share(n).alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def _with_entities(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) that have any entity, with the distinct ones as entities."""
    has = F.col("text").rlike(r"@|\+[0-9]|[0-9][\x20.-]?[0-9]")
    rows = docs.where(has).select("doc_id", "text", F.explode(F.array(_base_row(F.col("text")))).alias("b"))
    named = F.array_distinct(F.concat(*(_named(k) for k in KINDS[:4])))
    return rows.select("doc_id", "text", F.explode(F.array(named)).alias("entities")).where(F.size("entities") > 0)


def _share(n: int, n_et: Column | str = "n_et") -> Column:
    """The mutual information of term and entity as a share of the entity's, from n_e, n_t and n_et of n documents."""
    p = lambda c: (F.col(c) if isinstance(c, str) else c) / F.lit(float(n))
    return F.when(F.col("n_e") < n, F.log(p(n_et) / (p("n_e") * p("n_t"))) / -F.log(p("n_e"))).otherwise(F.lit(0.0))


def _named(kind: str) -> Column:
    return F.transform(f"b.{kind}", lambda s: F.concat(F.lit(f"{kind}:"), s["value"]))


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone, base and found (arrays of start, kind, end; by kind, then start).

    found holds the base spans and, as kind term, every occurrence of a term that discloses an entity of the same text (see
    disclosing), unless it lies in a base span.  So a text without an entity is left alone, whatever its words.  Null and empty texts have none; repeated rows have the same spans; an empty df gives no rows.
    Columns of df that have one of these names are kept; the new one then gets a _ after its name.
    """
    mine, c = packed(df, _id=F.col(doc_id), _text=F.coalesce(F.col(text), F.lit(""))), F.col("_text")
    docs = mine.select(F.col("_id").alias("doc_id"), c.alias("text"))
    flagged, n_flagged = _counted(disclosing(docs).select("entity", "term"))
    if n_flagged:
        held = _with_entities(docs).select(F.col("doc_id").alias("_pii_id"), F.xxhash64("text").alias("_th"), F.explode("entities").alias("entity"))
        at = stored(held.join(flagged, "entity").groupBy("_pii_id", "_th").agg(F.collect_set("term").alias("_terms")), "pii-terms")
        size = at.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_terms")), F.lit(0)).alias("terms")).first()
        at = F.broadcast(at) if size.rows <= BROADCAST_ROWS and size.terms <= BROADCAST_TERMS else at
        rows = mine.join(at, F.col("_id").eqNullSafe(F.col("_pii_id")) & (F.xxhash64("_text") == F.col("_th")), "left")
    else:
        rows = mine.withColumn("_terms", F.lit(None).cast("array<string>"))
    one = rows.withColumn("_b", F.explode(F.array(_base_row(c))))
    word = matches(c, rf"(?<!\p{{L}})\p{{L}}{{{TERM_LEAST},}}+")
    inside = lambda s: F.exists(F.concat(*(F.col(f"_b.{k}") for k in KINDS[:4])), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    extra = F.when(F.col("_terms").isNotNull(), F.filter(word, lambda s: F.array_contains("_terms", F.lower(s["value"])) & ~inside(s))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    spans = [kind_spans(F.col(f"_b.{k}"), i) for i, k in enumerate(KINDS[:4])]
    two = one.withColumn("_base", F.concat(*spans))
    counts = {f"n_{k}": F.size(f"_b.{k}").cast("long") for k in KINDS[:4]}
    return unpacked(two, df, **counts, base=F.col("_base"), found=F.concat("_base", kind_spans(extra, 4)))


def sanitised(text: Column, found: Column) -> Column:
    """text with each entity generalised to its kind, in angle brackets, and each disclosing term to <TERM>; overlaps are one."""
    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(tags, s["kind"])))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    done = let(F.aggregate(F.array_sort(found), zero, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of every whole text; a null text is empty, rows that repeat or lack a doc_id are rows like any other."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), digest(written(F.col("base"), KINDS)).alias("base_sha256"), written(F.col("found"), KINDS).alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its text is sanitised and n_chars counted anew.  Other columns, whatever their names, are kept."""
    rest = [c for c in docs.columns if c != "text"]
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct(*rest).alias("_row"))
    found = find(d, doc_id="_id", text="_text")
    clean = found.select("_row", F.explode(F.array(sanitised(F.col("_text"), F.col("found")))).alias("_clean"))
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("long")}
    return clean.select(*(new.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns))


def _matches_sql(name: str, pattern: str, good: str) -> str:
    """A table of doc_id, start, end and value of a pattern's matches that are good; the texts between them give the places."""
    return rf"""
{name}_m AS (SELECT doc_id, n, t, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')),
{name}_s AS (SELECT n, i, m[i] AS v, sum(length(g[i])) OVER w + sum(length(m[i])) OVER w - length(m[i]) AS s FROM {name}_m, unnest(range(1, len(m) + 1)) AS u(i) WINDOW w AS (PARTITION BY n ORDER BY i)),
{name} AS (SELECT n, s::BIGINT AS s, s::BIGINT + length(v) AS e, v, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM {name}_s WHERE {good})"""


SQL = (
    r"WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),"
    + _matches_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true") + ","
    + _matches_sql("ip", r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0") + ","
    + _matches_sql("card", r"[0-9](?:[\x20-]?[0-9])+", "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 13 AND 19") + ","
    + _matches_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15")
    + rf""",
luhn AS (SELECT n, s, e, v FROM card WHERE list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)::INTEGER
    ELSE (2 * substr(reverse(digits), i, 1)::INTEGER) // 10 + (2 * substr(reverse(digits), i, 1)::INTEGER) % 10 END)) % 10 = 0),
b AS (SELECT n, 0 AS k, 'email' AS kind, s, e, v FROM email UNION ALL SELECT n, 1, 'ip', s, e, v FROM ip UNION ALL SELECT n, 2, 'card', s, e, v FROM luhn UNION ALL SELECT n, 3, 'phone', s, e, v FROM phone),
t AS (SELECT n, unnest(list_distinct(regexp_split_to_array(lower(t), '[^\p{{L}}]+'))) AS term FROM d),
t3 AS (SELECT n, term FROM t WHERE length(term) >= {TERM_LEAST}),
en AS (SELECT DISTINCT n, kind || ':' || v AS entity FROM b),
ne AS (SELECT entity, count(*) AS n_e FROM en GROUP BY 1 HAVING count(*) >= {SUPPORT}),
et AS (SELECT entity, term, count(*) AS n_et FROM en JOIN ne USING (entity) JOIN t3 USING (n) GROUP BY 1, 2 HAVING count(*) >= {SUPPORT}),
nt AS (SELECT term, count(*) AS n_t FROM t3 WHERE term IN (SELECT term FROM et) GROUP BY 1),
fl AS (SELECT entity, term FROM et JOIN ne USING (entity) JOIN nt USING (term), (SELECT count(*)::DOUBLE AS all_ FROM d) WHERE n_e < all_ AND ln((n_et / all_) / ((n_e / all_) * (n_t / all_))) / -ln(n_e / all_) >= {DISCLOSURE}),
ft AS (SELECT DISTINCT n, term FROM en JOIN fl USING (entity)),
wd AS (SELECT n, regexp_extract_all(t, '\p{{L}}+') AS m, regexp_split_to_array(t, '\p{{L}}+') AS g FROM d WHERE n IN (SELECT n FROM ft)),
ws AS (SELECT n, m[i] AS v, sum(length(g[i])) OVER w + sum(length(m[i])) OVER w - length(m[i]) AS s FROM wd, unnest(range(1, len(m) + 1)) AS u(i) WINDOW w AS (PARTITION BY n ORDER BY i)),
x AS (SELECT n, s::BIGINT AS s, s::BIGINT + length(v) AS e FROM ws WHERE length(v) >= {TERM_LEAST} AND (n, lower(v)) IN (SELECT (n, term) FROM ft) AND NOT EXISTS (SELECT 1 FROM b WHERE b.n = ws.n AND b.s < ws.s + length(ws.v) AND b.e > ws.s)),
a AS (SELECT n, k, kind, s, e FROM b UNION ALL SELECT n, 4, 'term', s, e FROM x),
r AS (SELECT n, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM a GROUP BY n)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON r.n = d.n
"""
)
