"""Text functions as Column expressions: splitting, masking, similarity, tokens, vectors, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBEDDING_DIM = 512


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that isn't blank, stripped; else the empty string."""
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in columns], F.lit(""))


def preview(text: Column, limit: int = 1000, suffix: str = "...(truncated)") -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit(suffix)))


# --- splitting ------------------------------------------------------------------------------------


def paragraphs(text: Column) -> Column:
    """Lines without blank ones, stripped."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")


#: What ends a sentence in parsed paragraphs.
PARSED_ENDS = "。！？;"
#: What ends a sentence when two versions are compared.
COMPARED_ENDS = "。！？；\n"
#: What ends a sentence inside a clause.
CLAUSE_ENDS = "。；;！？!?"


def parsed_sentences(paragraph: Column, ends: str = PARSED_ENDS) -> Column:
    """Array of (text, start, end): runs without an end mark, with the end marks that follow."""
    found = F.regexp_extract_all(paragraph, F.lit(f"[^{ends}]+[{ends}]*"), F.lit(0))
    # end marks before the first sentence belong to none
    lead = F.length(paragraph) - F.length(F.regexp_replace(paragraph, f"^[{ends}]+", ""))
    step = lambda acc, s: F.struct(
        (acc["at"] + F.length(s)).alias("at"),
        F.array_append(acc["out"], F.struct(s.alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(s)).alias("end"))).alias("out"),
    )
    zero = F.struct(lead.alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))
    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def compared_sentences(text: Column, ends: str = COMPARED_ENDS) -> Column:
    """Pieces up to and with an end mark, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, rf"(?<=[{ends}])(?U)\s*"), strip), lambda s: s != "")


def clause_sentences(text: Column, ends: str = CLAUSE_ENDS) -> Column:
    """Runs without an end mark, with one end mark at most, stripped, without blank ones."""
    found = F.regexp_extract_all(text, F.lit(f"[^{ends}]+[{ends}]?"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


# --- masking --------------------------------------------------------------------------------------

#: Pattern and token, in the order in which they are applied.
MASKS_ZH = (
    (r"(?U)\d{11}", "[手机号]"),
    (r"(?U)\d{3,4}[-\s]?\d{7,8}", "[电话号码]"),
    (r"(?U)[\w.-]+@[\w.-]+\.\w+", "[邮箱]"),
    (r"(?U)622\d{13}", "[银行卡]"),
)
#: Masks for Latin texts, without look-around, so that any regular-expression engine agrees on them.
MASKS_LATIN = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "[EMAIL]"),
    (r"\+[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[PHONE]"),
    (r"[0-9]{16}", "[CARD]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
)


def mask(text: Column, masks=MASKS_LATIN) -> Column:
    for pattern, token in masks:
        text = F.regexp_replace(text, pattern, token.replace("$", r"\$"))
    return text


# --- similarity -----------------------------------------------------------------------------------


def chars(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two texts' sets of characters; 0 if either is empty."""
    both = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    made = let(chars(a), lambda x: let(chars(b), lambda y: F.when((F.size(x) > 0) & (F.size(y) > 0), both(x, y)).otherwise(0.0)))
    return F.coalesce(made, F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """As char_jaccard, of two texts' chars that are there already."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.coalesce(F.when(some, let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))), F.lit(0.0))


def clean(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\w一-鿿]", "")


def clean_jaccard(a: Column, b: Column) -> Column:
    return char_jaccard(clean(a), clean(b))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; a zero vector as it is."""
    return let(F.sqrt(inner_product(v, v)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))


def flat(text: Column) -> Column:
    """text in lower case without white space"""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


# --- tokens ---------------------------------------------------------------------------------------


def grams(text: Column, sizes) -> Column:
    """All runs of each size of characters, in order, each size by one pass over the text."""
    of = lambda n: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.concat(*[of(n) for n in sizes])


def bm25_tokens(text: Column) -> Column:
    """CJK runs and ASCII words of the lower-cased text, then pairs of characters of the raw text that aren't blank."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[一-鿿]+|[a-z0-9]+"), F.lit(0))
    return F.concat(words, F.regexp_extract_all(text, F.lit(r"(?sU)(?=(\S.|.\S))."), F.lit(1)))


def embedding_tokens(text: Column) -> Column:
    """ASCII words, then runs of one to four characters of the text without white space, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return let(F.regexp_replace(F.lower(text), r"(?U)\s+", ""), lambda t: F.concat(words, grams(t, (1, 2, 3, 4))))


def context_tokens(text: Column) -> Column:
    """Words with digits or per cent, CJK runs of two or more, and runs of two to four characters; distinct."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9%]+|[一-鿿]{2,}"), F.lit(0))
    return F.array_distinct(let(F.regexp_replace(F.lower(text), r"(?U)\s+", ""), lambda t: F.concat(words, grams(t, (2, 3, 4)))))


def token_slot(token: Column, dim: int = EMBEDDING_DIM) -> Column:
    """(slot, sign) of a token in a hashed embedding: from its MD5 digest's first four bytes and the fifth's parity."""
    digest = F.md5(token.cast("binary"))
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    return F.struct((number(1, 8) % dim).cast("int").alias("slot"), F.when(number(9, 2) % 2 == 0, 1).otherwise(-1).alias("sign"))


# --- keywords -------------------------------------------------------------------------------------

#: Words that are no keywords.
STOP_WORDS_ZH = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看",
    "好", "自己", "这", "那", "它", "他", "她", "们", "这个", "那个", "什么", "怎么", "为什么", "如果", "因为", "所以", "但是", "而且", "或者", "以及",
)


def keywords(text: Column, most: int = 5, stop=tuple(STOP_WORDS_ZH)) -> Column:
    """The first pieces between punctuation that have two characters or more and aren't stop words."""
    pieces = F.transform(F.split(text, '[，。！？；：、\'" （）]'), strip)
    return F.slice(F.filter(pieces, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)), 1, most)


def keyword_ratio(text: Column, wanted: Column) -> Column:
    """Share of wanted words that text has, whatever the case; 1 if none is wanted."""
    hit = F.filter(wanted, lambda w: F.contains(F.lower(text), F.lower(w)))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(hit) / F.size(wanted))


def covers(text: Column, facts: Column) -> Column:
    """Whether text has, of each list of alternatives in facts, one at least."""
    return F.forall(facts, lambda options: F.exists(options, lambda o: F.contains(text, o)))


# --- spans and mappings ---------------------------------------------------------------------------


def splice(text: Column, spans: Column) -> Column:
    """text with spans (start, end, replace_text) replaced from the right; spans don't overlap."""
    step = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["replace_text"], F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(F.reverse(F.array_sort(spans)), text, step)


def _replace_all(text: Column, pairs: Column, from_: str, to: str) -> Column:
    longest = F.array_sort(F.transform(pairs, lambda p, i: F.struct((-F.length(p[from_])).alias("k"), i.alias("i"), p.alias("p"))))
    usable = F.filter(longest, lambda x: (F.coalesce(x["p"][from_], F.lit("")) != "") & (F.coalesce(x["p"][to], F.lit("")) != ""))
    return F.aggregate(usable, F.coalesce(text, F.lit("")), lambda t, x: F.replace(t, x["p"][from_], x["p"][to]))


def restore(text: Column, mappings: Column) -> Column:
    """Placeholders back to originals, longest placeholder first."""
    return _replace_all(text, mappings, "placeholder", "original")


def redact_with(text: Column, mappings: Column) -> Column:
    """Originals to placeholders, longest original first."""
    return _replace_all(text, mappings, "original", "placeholder")
