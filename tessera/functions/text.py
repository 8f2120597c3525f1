"""Text as columns: tokens, paragraphs, sentences, normal forms, identities.

All of these are expressions of the JVM; none calls Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the closed-class words that the sparse index leaves out
STOPWORDS = tuple(
    """
    a an the of and or to in for on with is are was were be been being this that these
    those we our us it its as by from at can could may might must shall should will
    would not no nor than then so such but if into onto over under about above below
    there here when where which who whom whose what why how all any both each few more
    most other some only own same too very do does did done have has had having
    """.split()
)
WORDS = "[a-z0-9]+"
PARAGRAPH_BREAK = r"\n\s*\n|\n(?=[A-Z])"
SENTENCE_BREAK = r"(?<=[.!?])\s+"
SPACES = r"\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """All lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORDS), F.lit(0))


def terms(text: Column | str, remove_stopwords: bool = True) -> Column:
    """Word tokens without stop words; digits stay inside tokens, repeats stay."""
    found = words(text)
    if not remove_stopwords:
        return found
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS))  # a set of constants


def _pieces(text: Column | str, pattern: str) -> Column:
    trimmed = F.transform(F.split(col(text), pattern), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def paragraphs(text: Column | str) -> Column:
    """Trimmed, non-empty paragraphs; never none: a text without any is its own."""
    found = _pieces(text, PARAGRAPH_BREAK)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(col(text))))


def sentences(text: Column | str) -> Column:
    return _pieces(text, SENTENCE_BREAK)


def spans(text: Column | str, pieces: Column | str) -> Column:
    """Where each piece stands in the text: array of (text, start, end), found from left
    to right, each from the end of the one before."""
    text, pieces = col(text), col(pieces)
    empty = F.from_json(F.lit("[]"), "array<struct<text:string,start:int,end:int>>")

    def step(done: Column, piece: Column) -> Column:
        at = F.when(F.size(done) > 0, F.element_at(done, -1)["end"]).otherwise(0)
        found = F.call_function("locate", piece, text, at + 1)
        start = F.when(found > 0, found - 1).otherwise(at)
        return F.concat(done, F.array(F.struct(piece.alias("text"), start.cast("int").alias("start"), (start + F.length(piece)).cast("int").alias("end"))))

    return F.aggregate(pieces, empty, step)


def token_count(text: Column | str) -> Column:
    """The default token counter: words and single marks."""
    return F.size(F.regexp_extract_all(col(text), F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"), F.lit(0)))


def normal_title(title: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(title)), "[^a-z0-9]+", " "))


def normal_query(query: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(query))), SPACES, " ")


def fingerprint(text: Column | str) -> Column:
    return F.array_join(words(text), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def chunk_identity(paper_id: Column | str, start: Column | str, end: Column | str, text: Column | str) -> Column:
    """The derived id of a chunk: it changes exactly if place or text does."""
    key = F.concat_ws(":", col(paper_id).cast("string"), col(start).cast("string"), col(end).cast("string"), col(text))
    return F.substring(F.sha2(key, 256), 1, 16)


def paper_identity(arxiv_id: Column | str) -> Column:
    return F.substring(F.sha1(col(arxiv_id)), 1, 10)


def draft_identity(revision: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("d"), col(revision).cast("string"), F.lit("-"), F.substring(F.sha2(col(text), 256), 1, 8))


def hash_slot(key: Column, n: int | Column) -> Column:
    """A number in [0, n) from the first 32 bits of the key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))
