"""Personal data: identifiers by pattern, and terms that give an identifier away.

Everything is DataFrame and SQL functions. Identifiers (e-mail, IP, card, phone) are found by linear-time
forms of the given patterns. Then corpus co-occurrence tells how strongly a term of a document that holds a
protected entity reveals it. Entities are identifiers by exact value, and the classes they fall into: all of a
kind, and those of one e-mail domain, network (two parts of an IP), card issuer (six digits) or country code.
With document frequencies, a term t would disclose an entity e if PMI(e; t) = log2(P(e | t) * N / df(e)) >= ALPHA * IC(e), where
IC(e) = log2(N / df(e)): if knowing t took away ALPHA of the information that e carries. But of a term seen once beside an identifier
seen once that is true by construction, so nothing is judged on fewer than MIN_SUPPORT documents that hold both, and P(e | t) isn't
taken as df(e, t) / df(t) but as the lower end of its confidence interval (Wilson's, Z standard deviations): a term that was met a
few times must meet e nearly always, one that was met often may miss it at times. Equal texts that hold identifiers count
once, so that copies of a document don't vouch for each of its words.
Entities that are in just the same documents disclose alike, so one stands for all of them: a document with
thousands of identifiers of its own is one entity with its terms, not thousands.
Terms are runs of two or more letters and digits (names of several words are judged word by word), taken from whole documents, outside
their identifiers, and every occurrence of a disclosing term in any document gets a span of kind `term`. sanitise() removes terms that
always come with e; the others it generalises: to the broader term that a table gives for them, else to their kind.

Defined results: null text counts as empty and has no spans; spans are half-open ranges of code points,
sorted by start, then kind; of spans that overlap sanitise() takes the first; rows that repeat id and text
each get their spans; an empty table gives an empty result; columns other than id and text are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, shared_dir, table, written

KINDS = ("email", "ip", "card", "phone", "term")

#: Possessive forms that match just what the plain patterns do: a run is tried from its start only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of digits with single separators, whole, of 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]{2,}"
MIN_SUPPORT = 3
ALPHA = 0.9
#: Standard deviations: 9 of 10 shares lie above the lower end.
Z = 1.2816
#: Bits by which a threshold may be missed for the rounding of logarithms.
ROUNDING = 1e-9


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of pattern's matches in text."""
    return _walked(text, pattern, lambda value: F.lit(True))


def _walked(text: Column, pattern: str, wanted) -> Column:
    """As matches(), of those whose value is wanted."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(found: Column) -> Column:
        def walk(gaps: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                value, start = F.get(found, i), acc["at"] + F.length(F.get(gaps, i))
                end = start + F.length(value)
                one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"))
                return F.struct(end.alias("at"), F.when(wanted(value), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

            zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"])

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            twice = x * 2
            return acc + F.when(i % 2 == 1, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(F.reverse(F.regexp_replace(value, "[^0-9]", "")), total) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value) of identifiers, sorted; kind is a place in KINDS."""
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    gates = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": text.contains("+")}
    valid = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"),
        "card": _luhn,
        "phone": lambda v: digits(v).between(9, 15),
    }
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def of_kind(k: int, name: str) -> Column:
        good = F.filter(matches(text, PATTERNS[name]), lambda m: valid[name](m["value"]))
        typed = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(gates[name], typed).otherwise(none)

    return F.array_sort(F.concat(*[of_kind(k, name) for k, name in enumerate(KINDS[:4])]))


def _blanked(text: Column, base: Column) -> Column:
    """text with blanks in the place of its identifiers; other places stay."""

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        told = F.array_append(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"])), F.repeat(F.lit(" "), s["end"] - start))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), told.alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(base, zero, step, lambda acc: F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))), ""))
    return F.when(F.size(base) == 0, text).otherwise(done)


def entities_of(base: Column) -> Column:
    """Names of the entities that base spans belong to: kind, kind~class and kind=value of each, distinct."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")

    def classed(b: Column) -> Column:
        v = b["value"]
        by_kind = (
            F.lower(F.element_at(F.split(v, "@"), -1)),
            F.regexp_extract(v, r"^[0-9]+\.[0-9]+\.", 0),
            F.substring(digits(v), 1, 6),
            F.regexp_extract(v, r"^\+[0-9]{1,3}", 0),
        )
        chosen = F.get(F.array(*by_kind), b["kind"])
        kind = b["kind"].cast("string")
        return F.array(kind, F.concat(kind, F.lit("~"), chosen), F.concat(kind, F.lit("="), v))

    return F.array_distinct(F.flatten(F.transform(base, classed)))


def wilson_low(k: Column, n: Column) -> Column:
    """The lower end of the confidence interval of a share that was k of n."""
    p, z2 = k / n, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing(base: DataFrame, folder: str, alpha: float = ALPHA, support: int = MIN_SUPPORT) -> DataFrame:
    """(entity, term, certain) of terms over the threshold. base: (row, text_key, entities, words), one row for each document.

    entity stands for every entity that is in just the same documents.
    """
    holds = F.size("entities") > 0
    holders = written(base.where(holds).select("row", "text_key", "entities", "words").dropDuplicates(["text_key"]), f"{folder}/holders")
    n = float(base.where(~holds).count() + holders.count())
    entities = holders.select("row", F.explode("entities").alias("entity"))
    places = [F.bit_xor(F.xxhash64(F.lit(seed), F.col("row"))).alias(f"x{seed}") for seed in (1, 2)]
    met = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"), *places).where(F.col("df_entity").between(support, n - 1))
    df_entity = written(met.groupBy("df_entity", "x1", "x2").agg(F.min("entity").alias("entity")).select("entity", "df_entity"), f"{folder}/entities")
    most = df_entity.agg(F.max("df_entity")).first()[0] or 0
    # df(e, t) is at most df(e), so a pair passes only if df(t) <= df(e) * (N / df(e)) ** (1 - alpha)
    reach = lambda df: n ** (1 - alpha) * df**alpha * (1 + 1e-9)
    counted = base.where(~holds).select("words").unionByName(holders.select("words"))
    terms = counted.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    terms = written(terms.where(F.col("df_term").between(F.lit(float(support)), F.lit(float(max(reach(most), most))))), f"{folder}/words")
    told = holders.select("row", F.explode("words").alias("term")).join(broadcast_if_small(terms), "term")
    known = entities.join(broadcast_if_small(df_entity), "entity")
    pairs = known.join(told, "row").where(F.col("df_term") <= F.greatest(F.col("df_entity"), F.lit(n) ** (1 - alpha) * F.col("df_entity") ** alpha * (1 + 1e-9)))
    both = pairs.groupBy("entity", "term", "df_entity", "df_term").agg(F.count(F.lit(1)).alias("df_both")).where(F.col("df_both") >= support)
    ic = F.log2(F.lit(n) / F.col("df_entity"))
    pmi = F.log2(wilson_low(F.col("df_both"), F.col("df_term")) * n / F.col("df_entity"))
    passed = both.where(pmi >= ic * alpha - ROUNDING)
    return written(passed.select("entity", "term", (F.col("df_both") >= F.col("df_term")).alias("certain")), f"{folder}/disclosing")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = MIN_SUPPORT) -> DataFrame:
    """One row for each row of docs: doc_id, id and text_key (its name), base spans, all spans.

    all: array of (start, kind, end, certain), base identifiers and disclosing terms.
    """
    folder = shared_dir(docs.sparkSession, "pii")
    docs = _named(docs, id_col, text_col)
    entities = entities_of(F.col("base"))
    words = F.array_distinct(F.transform(F.regexp_extract_all(_blanked(F.col("text"), F.col("base")), F.lit(TERM), F.lit(0)), F.lower))
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "id", "text_key", "text", base_spans(F.col("text")).alias("base"))
    base = written(base.select("row", "doc_id", "id", "text_key", "base", entities.alias("entities"), words.alias("words")), f"{folder}/base")
    given = written(disclosing(base, folder, alpha, support).groupBy("term").agg(F.max("certain").alias("certain")), f"{folder}/given")
    hits = base.select("id", "text_key", "base", F.explode("words").alias("term")).join(broadcast_if_small(given), "term")
    hits = hits.groupBy("id", "text_key").agg(F.first("base").alias("base"), F.collect_set(F.when(F.col("certain"), F.col("term"))).alias("sure"), F.collect_set("term").alias("hit"))
    hits = broadcast_if_small(written(hits, f"{folder}/hits"))
    found = docs.select("id", "text_key", "text").join(hits, ["id", "text_key"])
    places = _walked(_blanked(F.col("text"), F.col("base")), TERM, lambda v: F.array_contains("hit", F.lower(v)))
    typed = F.transform(places, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), m["end"].alias("end"), F.array_contains("sure", F.lower(m["value"])).alias("certain")))
    terms = written(found.select("id", "text_key", typed.alias("terms")).groupBy("id", "text_key").agg(F.first("terms").alias("terms")), f"{folder}/terms")
    joined = base.select("doc_id", "id", "text_key", "base").join(broadcast_if_small(terms), ["id", "text_key"], "left")
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(False).alias("certain")))
    spans = F.array_sort(F.concat(plain, F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,certain:boolean>>"))))
    return joined.select("doc_id", "id", "text_key", "base", spans.alias("all"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    id = F.col(f"`{id_col}`").cast("long")
    return docs.select(id.alias("doc_id"), F.coalesce(id, F.lit(0)).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = MIN_SUPPORT, broader: DataFrame | None = None) -> DataFrame:
    """doc_id and the sanitised text: identifiers replaced by their kind, disclosing terms by a broader term or their kind, certain ones removed.

    broader: (term, broader), terms in lower case; one row a term. A broader term that discloses something itself isn't taken.
    """
    folder = shared_dir(docs.sparkSession, "sanitise")
    found = written(find_pii(docs, id_col, text_col, alpha, support).where(F.size("all") > 0).select("id", "text_key", "all").dropDuplicates(["id", "text_key"]), f"{folder}/found")
    named, text = _named(docs, id_col, text_col), F.col("text")
    labelled = F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["certain"], "").otherwise(F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), s["kind"])), F.lit("]"))).alias("label")))
    spans = found.select("id", "text_key", labelled.alias("spans"))
    if broader is not None:
        # each term span with its word; a document's spans come together again by its name
        one = named.select("id", "text_key", "text").dropDuplicates(["id", "text_key"]).join(found, ["id", "text_key"]).select("id", "text_key", F.posexplode("all").alias("i", "s"), "text")
        term = F.when(F.col("s.kind") == KINDS.index("term"), F.lower(F.substring(text, F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))))
        one = written(one.select("id", "text_key", "i", "s", term.alias("term")), f"{folder}/one")
        terms = one.where("term IS NOT NULL").select("term").distinct()
        known = broader.select("term", F.col("broader")).dropDuplicates(["term"]).join(terms.withColumnRenamed("term", "gives"), F.lower("broader") == F.col("gives"), "left_anti")
        known = broadcast_if_small(written(known.join(terms, "term", "left_semi"), f"{folder}/broader"))
        name = F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), F.col("s.kind"))), F.lit("]"))
        label = F.when(F.col("s.certain"), "").otherwise(F.coalesce("broader", name))
        spans = one.join(known, "term", "left").groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("i", F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), label.alias("label")).alias("s")))).alias("x"))
        spans = spans.select("id", "text_key", F.transform("x", lambda x: x["s"]).alias("spans"))
    joined = named.join(spans, ["id", "text_key"], "left")

    def step(acc: Column, s: Column) -> Column:
        told = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), told.alias("out")))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select("doc_id", F.when(F.col("spans").isNull(), text).otherwise(done).alias("text"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("all")).alias("spans"))
