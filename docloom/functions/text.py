"""Text columns: folding, tokens, n-grams, redaction, matching. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import markers as M

SPACE = r"[ \t\n\x0B\f\r]"
STRIP = rf"^{SPACE}+|{SPACE}+$"
CJK = r"[^\x{4E00}-\x{9FFF}]"
TECHNICAL = r"[a-z0-9]+(?:[._%/\-][a-z0-9]+)*%?"
LATIN = r"[a-z0-9]{2,}"
QUERY_TOKENS = 96


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def text_of(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def fold(c: Column | str) -> Column:
    """Case folding; the sharp s is the one letter in scope that folds to two."""
    return F.replace(F.lower(text_of(c)), F.lit("ß"), F.lit("ss"))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), STRIP, "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(c), rf"{SPACE}+", " ")


def cjk_of(c: Column) -> Column:
    return F.regexp_replace(c, CJK, "")


def grams(c: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: c.substr(i, F.lit(n)))).otherwise(none)


def bm25_tokens(c: Column | str) -> Column:
    """Technical tokens in order, then 4- to 1-grams of the CJK characters; duplicates stay."""
    f = fold(c)
    cjk = cjk_of(f)
    return F.concat(F.regexp_extract_all(f, F.lit(TECHNICAL), F.lit(0)), *[grams(cjk, n) for n in (4, 3, 2, 1)])


def query_tokens(c: Column | str) -> Column:
    return F.slice(F.array_distinct(bm25_tokens(c)), 1, QUERY_TOKENS)


def lexical_terms(c: Column | str) -> Column:
    """Set of latin words of two or more characters and CJK 1- to 4-grams."""
    low = F.lower(text_of(c))
    cjk = cjk_of(low)
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(LATIN), F.lit(0)), *[grams(cjk, n) for n in (1, 2, 3, 4)]))


def rerank_terms(c: Column | str) -> Column:
    low = F.lower(text_of(c))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(LATIN), F.lit(0)), grams(cjk_of(low), 1)))


def lexical_score(query_terms: Column, text_terms: Column) -> Column:
    both = F.size(F.array_intersect(query_terms, text_terms))
    return lexical_score_of(both, F.size(query_terms), F.size(text_terms))


def lexical_score_of(shared: Column, n_query: Column, n_text: Column) -> Column:
    score = 0.75 * shared / n_query + 0.25 * shared / F.greatest(F.sqrt(n_text.cast("double")), F.lit(1.0))
    return F.when((n_text > 0) & (n_query > 0), score).otherwise(0.0)


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def count_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(c, F.lit(w)).cast("int")
    return out


def redact_secrets(c: Column | str) -> Column:
    out = text_of(c)
    for p in M.SECRETS:
        out = F.regexp_replace(out, p, "[REDACTED]")
    return out


def normalise_for_match(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), r"[^0-9a-z\x{4e00}-\x{9fff}%]+", "")


def compact(c: Column | str) -> Column:
    return F.regexp_replace(fold(c), r"[\s._\-\\/：:（）()\[\]【】]+", "")


def citations(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))


def preview(c: Column | str, limit: int) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("..."))).otherwise(s)


def suffix_of(name: Column) -> Column:
    """Lower-cased file suffix with its dot, or an empty string."""
    return F.regexp_extract(F.lower(name), r"[^./\\](\.[^./\\]+)$", 1)


def stem_of(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def source_path(c: Column | str) -> Column:
    """Forward slashes, without empty, ``.`` and ``..`` parts; ``untitled`` if nothing is left."""
    parts = F.filter(F.split(F.replace(text_of(c), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) == 0, F.lit("untitled")).otherwise(F.array_join(parts, "/"))


def document_id(c: Column | str) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(fold(source_path(c)), 256), 1, 24))


def best_sentence(text: Column | str, query: Column | str, limit: int = 240) -> Column:
    """The sentence with most distinct characters of the query; the earliest on ties; citations removed."""
    chars = F.array_distinct(F.split(F.lower(text_of(query)), ""))
    parts = F.filter(F.transform(F.split(text_of(text), r"[。！？!?]\s*|\n+"), strip), lambda s: F.length(s) > 0)
    scored = F.transform(parts, lambda s, i: F.struct(F.size(F.array_intersect(F.array_distinct(F.split(s, "")), chars)).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.when(F.size(parts) > 0, F.array_max(scored)["s"]).otherwise(text_of(text))
    return strip(F.substring(F.regexp_replace(best, r"\[\d+\]", ""), 1, limit))
