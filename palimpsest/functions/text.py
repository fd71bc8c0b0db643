"""Text expressions: trimming, tokens, trigrams, summaries. Built-in functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a token.
TOKEN_END = r"[ \t\n\-_:,.]+"


#: Unicode's white space, as \s under (?U).
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (any Unicode one) at both ends."""
    return F.btrim(c, F.lit(SPACE))


def folded(c: Column) -> Column:
    """Lower-cased and stripped: how keys of duplicates and searched texts compare."""
    return strip(F.lower(c))


def text_or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) == "", None).otherwise(c)


#: The same with the white space (any Unicode one) that a token would be stripped of.
_GAP = r"(?U)\s*[ \t\n\-_:,.]+[\s\-_:,.]*"


def terms(c: Column) -> Column:
    """Lower-cased and stripped tokens in order, repeats included: one split, no work a token."""
    return F.array_remove(F.split(folded(c), _GAP), "")


def tokens(c: Column) -> Column:
    """Each token once, in order of first occurrence."""
    return F.array_distinct(terms(c))


def query_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(t.strip() for t in re.split(TOKEN_END, text.lower()) if t.strip()))


def _equals(token: str):
    return lambda x: x == token


def sparse_score(own: Column, query: list[str], idf: dict[str, float]) -> Column:
    """Saturated frequencies of a text's terms weighted by idf, averaged over the query's tokens, at most 1."""
    if not query:
        return F.lit(0.0)
    size = F.size(own).cast("double")
    total = F.lit(0.0)
    for t in query:
        tf = F.size(F.filter(own, _equals(t))).cast("double")
        total = total + F.when(F.array_contains(own, t), F.lit(idf.get(t, 1.0)) * tf / (tf + 1.2 + size * 0.25)).otherwise(0.0)
    return F.least(F.lit(1.0), total / len(query))


def idf(n_docs: int, df: int) -> float:
    return math.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def collapsed(c: Column) -> Column:
    """Lower-cased, with single blanks between words."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def trigrams(c: Column) -> Column:
    """Runs of three characters of a collapsed text, repeats included; none for shorter texts."""
    # One character is consumed, two more are looked at: linear in the text, in one native call.
    return F.regexp_extract_all(c, F.lit("(?s)(?=(...))."), F.lit(1))


def query_trigrams(text: str) -> dict[str, int]:
    text = " ".join(text.lower().split())
    out: dict[str, int] = {}
    for i in range(len(text) - 2):
        out[text[i : i + 3]] = out.get(text[i : i + 3], 0) + 1
    return out


def trigram_product(c: Column, grams: dict[str, int]) -> Column:
    """Product of a collapsed text's trigram counts with a query's: one look at each place for each weight."""
    by_weight: dict[int, list[str]] = {}
    for g, n in grams.items():
        by_weight.setdefault(n, []).append(re.sub(r"([^\w\s])", r"\\\1", g))
    out = F.lit(0)
    for n, own in by_weight.items():
        out = out + F.lit(n) * F.regexp_count(c, F.lit(f"(?s)(?=(?:{'|'.join(own)}))"))
    return out


def trigram_square(c: Column) -> Column:
    """Sum of the squares of a collapsed text's trigram counts, in one pass over the sorted trigrams."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, g: Column) -> Column:
        run = F.when(a["last"] == g, a["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(g.alias("last"), (run + 1).alias("run"), (a["sum"] + 2 * run + 1).alias("sum"))

    return F.aggregate(F.array_sort(trigrams(c)), start, step, lambda a: a["sum"])


def summary(c: Column) -> Column:
    """At most 80 characters: longer texts keep 77 and three dots."""
    c = strip(c)
    return F.when(F.length(c) <= 80, c).otherwise(F.concat(F.left(c, F.lit(77)), F.lit("...")))


def clipped(c: Column, most: int) -> Column:
    return F.left(text_or_empty(c), F.lit(most if most > 0 else 512))


def distinct_texts(c: Column) -> Column:
    """Stripped, blanks dropped, each once in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != ""))


def id_part(c: Column) -> Column:
    """Lower-cased, stripped, blanks and slashes as dashes."""
    return F.translate(folded(text_or_empty(c)), " /", "--")


def entity_id(namespace: Column, kind: Column, name: Column) -> Column:
    return F.regexp_replace(F.concat(id_part(namespace), F.lit(":"), id_part(kind), F.lit(":"), id_part(name)), "^:+|:+$", "")


def source_id(space: Column, kind: Column, ref: Column) -> Column:
    return F.concat(F.lit("src:"), id_part(space), F.lit(":"), id_part(kind), F.lit(":"), id_part(ref))
