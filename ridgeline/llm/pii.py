"""Personal data: exact spans of four kinds, and terms of the corpus that disclose them.

Base spans are found with fixed patterns.  Their values are the protected entities.  A term (a word of three letters or more) that
shares a line with an entity discloses the share PMI(term; entity) / IC(entity) of the entity's information, where the pointwise
mutual information and the information content -log2 p come from document counts over the whole corpus.  A term that is alone with
an entity discloses all of it, an independent term nothing.  In the documents that hold the entity, terms above REMOVE are removed
and terms above GENERALISE are cut to their first letters.  A term needs SUPPORT different contexts with the entity: what copies of
one text share is no evidence.

All of it is DataFrame and SQL functions.  Positions are code points, ends exclusive.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import staged

KINDS = ("email", "ip", "card", "phone")
ADDED = ("term", "stem")
GENERALISE, REMOVE, SUPPORT = 0.85, 0.95, 3
STEM = 3
BLOCK = 256  # matches

# The contract's patterns in forms that a backtracking engine matches in linear time: possessive, and starting only where a match can.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits with at most one blank or hyphen between them, if they have 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "struct<start:bigint,end:bigint,kind:string,hit:string>"
_WORD = r"\p{L}{3,}"


def _text_sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str, kind: str, worth: str = "true") -> str:
    """SQL for all matches of a pattern (an SQL expression) in a text as an array of spans, if `worth` holds.

    Positions are sums of the lengths before.  They are added up within blocks of BLOCK matches that start from the sums of the blocks
    before, as appending to an array copies it: the work grows with the matches, not with their square.
    """
    hits = f"regexp_extract_all({text}, {pattern}, 0)"
    pieces = f"zip_with({hits}, slice(split({text}, {pattern}, -1), 1, size({hits})), (h, g) -> struct(h AS hit, length(g) AS gap))"
    blocks = f"transform(sequence(0, int((size(p) - 1) div {BLOCK})), k -> slice(p, k * {BLOCK} + 1, {BLOCK}))"
    starts = """aggregate(transform(bs, b -> aggregate(b, 0L, (a, x) -> a + x.gap + length(x.hit))),
        struct(0L AS at, cast(array() AS array<bigint>) AS found),
        (acc, n) -> struct(acc.at + n AS at, concat(acc.found, array(acc.at)) AS found), acc -> acc.found)"""
    walk = f"""aggregate(b, struct(o AS at, cast(array() AS array<{_SPAN}>) AS found),
        (acc, x) -> struct(acc.at + x.gap + length(x.hit) AS at,
                           concat(acc.found, array(struct(acc.at + x.gap AS start,
                                  acc.at + x.gap + length(x.hit) AS end, {kind} AS kind, x.hit AS hit))) AS found),
        acc -> acc.found)"""
    whole = f"flatten(transform(array({pieces}), p -> flatten(transform(array({blocks}), bs -> flatten(zip_with(bs, {starts}, (b, o) -> {walk}))))))"
    return f"if(({worth}) AND size({hits}) > 0, {whole}, cast(array() AS array<{_SPAN}>))"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(value: str) -> str:
    """Whether the digits of a value pass the Luhn check."""
    d = f"split(reverse({_digits(value)}), '')"
    return (f"aggregate(transform({d}, (c, i) -> CASE WHEN i % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 "
            f"ELSE 2 * int(c) END), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0")


def base_spans(text: str = "text") -> Column:
    """All base spans of a text (null counts as empty), by kind and start."""
    t = f"coalesce({text}, '')"
    valid = {"email": "true", "ip": f"x.hit RLIKE {_text_sql(f'^{_PART}(?:[.]{_PART}){{3}}$')}", "card": _luhn("x.hit"),
             "phone": f"length({_digits('x.hit')}) BETWEEN 10 AND 15"}
    worth = {"email": f"contains({t}, '@')", "phone": f"contains({t}, '+')"}
    return F.expr("concat(" + ", ".join(
        f"filter({spans_sql(t, _text_sql(PATTERNS[k]), repr(k), worth.get(k, 'true'))}, x -> {valid[k]})" for k in KINDS) + ")")


def in_order(spans: str) -> str:
    """SQL for spans by start and then kind as listed."""
    names = ", ".join(f"'{k}'" for k in (*KINDS, *ADDED))
    return (f"array_sort({spans}, (l, r) -> CASE WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 "
            f"ELSE int(sign(array_position(array({names}), l.kind) - array_position(array({names}), r.kind))) END)")


def joined(spans: str) -> str:
    """SQL for kind:start:end of spans in order, comma-joined."""
    return f"array_join(transform({in_order(spans)}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def _entity(span: str) -> str:
    return f"CASE WHEN {span}.kind IN ('card', 'phone') THEN concat({span}.kind, ':', {_digits(span + '.hit')}) ELSE concat({span}.kind, ':', lower({span}.hit)) END"


def _rest(line: str, span: str) -> str:
    """SQL for a line without one of its spans."""
    return f"concat_ws(' ', substring({line}, 1, int({span}.start)), substring({line}, int({span}.end) + 1))"


def found(docs: DataFrame) -> DataFrame:
    """(row, text, base): whole rows of docs with their base spans."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn(
        "base", base_spans("text"))


def contexts(marked: DataFrame) -> DataFrame:
    """(entity, words): for every document and entity, the different words on the entity's lines.

    No span crosses a line, so the spans of a line are found in it and the lines of a document are handled apart.
    """
    lines = marked.select(F.monotonically_increasing_id().alias("doc"), F.explode(F.split("text", "\n")).alias("line"))
    spans = lines.select("doc", "line", F.explode(base_spans("line")).alias("b"))
    words = F.expr(f"regexp_extract_all(lower({_rest('line', 'b')}), {_text_sql(_WORD)}, 0)")
    own = spans.select("doc", F.expr(_entity("b")).alias("entity"), words.alias("words"))
    return own.groupBy("doc", "entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words")).drop("doc")


def disclosures(marked: DataFrame, docs: DataFrame, least: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(entity, term, disclosure) of terms that disclose at least the share `least` of an entity."""
    context = staged(contexts(marked))
    entities = context.groupBy("entity").agg(F.count("*").alias("with_entity"))
    pairs = (context.select("entity", F.xxhash64("words").alias("context"), F.explode("words").alias("term"))
             .groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
             .groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("both"))
             .where(F.col("contexts") >= support))
    pairs = staged(pairs)
    wanted = pairs.select("term").distinct()
    words = F.expr(f"explode(array_distinct(regexp_extract_all(lower(text), {_text_sql(_WORD)}, 0)))")
    with_term = (docs.select(words.alias("term")).groupBy("term").agg(F.count("*").alias("with_term")).join(wanted, "term"))
    total = float(docs.count())
    share = F.log2(F.col("both") * total / (F.col("with_term") * F.col("with_entity"))) / F.log2(total / F.col("with_entity"))
    return (pairs.join(with_term, "term").join(entities, "entity").where(F.col("with_entity") < total)
            .select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= least))


def _with_terms(marked: DataFrame, disclosing: DataFrame, remove: float) -> DataFrame:
    """(row, text, base, added): added spans of disclosing terms in the documents that hold their entity."""
    keyed = marked.withColumn("text_key", F.md5("text"))
    per_text = (keyed.select("text_key", F.explode(F.expr(f"array_distinct(transform(base, b -> {_entity('b')}))")).alias("entity"))
                .distinct().join(disclosing, "entity").groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure"))
                .groupBy("text_key").agg(F.collect_set(F.struct("term", "disclosure")).alias("terms")))
    all_of = "transform(terms, t -> t.term)"
    strong = f"transform(filter(terms, t -> t.disclosure >= {remove!r}), t -> t.term)"
    pattern = f"concat('(?iu)(?<![\\\\p{{L}}])(?:', array_join({all_of}, '|'), ')(?![\\\\p{{L}}])')"
    kind = f"CASE WHEN array_contains({strong}, lower(x.hit)) THEN 'term' ELSE 'stem' END"
    hits = spans_sql("text", pattern, kind, "terms IS NOT NULL")
    return keyed.join(per_text, "text_key", "left").select(
        "row", "text", "base", F.expr(f"filter({hits}, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))").alias("added"))


def sanitised_parts(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Documents with base spans as (row, text, base, added), and all others as (row)."""
    seen = found(docs)
    marked = staged(seen.where(F.size("base") > 0))
    disclosing = staged(disclosures(marked, docs.select(F.coalesce("text", F.lit("")).alias("text")), generalise, support))
    return _with_terms(marked, disclosing, remove), seen.where(F.size("base") == 0).select("row")


def span_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs(doc_id, text, ...).

    A null text is empty; rows with null or repeated ids are reported as given; other columns are not read; an empty table gives an
    empty result.
    """
    marked, rest = sanitised_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    some = marked.select("row.doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"),
                         F.expr(joined("concat(base, added)")).alias("spans"))
    none = rest.select("row.doc_id", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS],
                       F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return some.unionByName(none)


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with the same columns and rows; in `text` each base span is replaced by its kind in angle brackets, disclosing terms are
    removed (`<term>`) or cut to their first letters and `*`.  A null text stays null."""
    marked, rest = sanitised_parts(docs)
    mark = f"CASE WHEN x.kind = 'stem' THEN concat(left(x.hit, {STEM}), '*') ELSE concat('<', x.kind, '>') END"
    text = f"""aggregate({in_order('concat(base, added)')}, struct(0L AS at, '' AS out),
        (acc, x) -> struct(greatest(acc.at, x.end) AS at,
            CASE WHEN x.start < acc.at THEN acc.out
                 ELSE concat(acc.out, substring(text, int(acc.at) + 1, int(x.start - acc.at)), {mark}) END AS out),
        acc -> concat(acc.out, substring(text, int(acc.at) + 1)))"""
    changed = marked.select(F.col("row").withField("text", F.expr(text)).alias("row"))
    return changed.unionByName(rest).select("row.*")
