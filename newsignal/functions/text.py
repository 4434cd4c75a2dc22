"""Text expressions: trimming, cleaning, words, n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank when text is trimmed.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What cleaning removes.
# The range from $ to _ holds all signs that a url may have, so single ones need not be named.
URL_PATTERN = r"https?://[!$-_a-z]+"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
DROPPED_CHARS = rf"[^\p{{L}}\p{{N}}_{BLANK}.,!?;:-]"

# Words are separated by blanks, , ; : ? ! and by runs of dashes or dots.
WORD_BREAK = rf"[{BLANK},;:?!]+|--+|\.\.\.+"
LETTERS_ONLY = r"^\p{L}+$"


def strip(text: Column) -> Column:
    """Without leading and trailing blanks of any kind (``trim`` alone removes only spaces)."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def without_links(text: Column) -> Column:
    """Without urls and e-mail addresses.

    The address pattern is slow on long text, so it runs only where there is an ``@``.
    """
    no_urls = F.regexp_replace(text, URL_PATTERN, "")
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(no_urls, EMAIL_PATTERN, "")).otherwise(no_urls)


def clean(text: Column) -> Column:
    """Without urls, e-mail addresses, repeated blanks and unusual characters."""
    squeezed = F.regexp_replace(without_links(text), f"[{BLANK}]+", " ")
    return strip(F.regexp_replace(squeezed, DROPPED_CHARS, ""))


def pieces(text: Column) -> Column:
    """The lower-cased, cleaned text cut at its breaks; dots at the ends of a piece are kept."""
    kept = F.regexp_replace(without_links(text), DROPPED_CHARS, "")
    return F.split(F.lower(kept), WORD_BREAK)


def bare(piece: Column) -> Column:
    return F.btrim(piece, F.lit("."))


def is_word(bare_piece: Column) -> Column:
    """Letters only: "growth." counts, "top-line" and "q3" do not."""
    return bare_piece.rlike(LETTERS_ONLY)


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.transform(pieces(text), bare), is_word)


def count_in(items: Column, wanted: Sequence[str]) -> Column:
    """How many pieces are among the words ``wanted``."""
    return F.size(F.filter(items, lambda p: bare(p).isin(*wanted))) if wanted else F.lit(0)


def ngrams(items: Column, sizes: Sequence[int]) -> Column:
    """All runs of n consecutive elements, joined by blanks.

    The array is zipped with itself shifted, which stays linear in its length.
    """
    length = F.greatest(F.size(items), F.lit(1))
    shifted = [F.slice(items, k + 1, length) for k in range(max(sizes))]

    def starting_at(run: Column) -> Column:
        parts = [run.getField(str(k)) for k in range(len(shifted))]
        return F.array(*(F.when(parts[n - 1].isNotNull(), F.concat_ws(" ", *parts[:n])) for n in sizes))

    return F.array_compact(F.flatten(F.transform(F.arrays_zip(*shifted), starting_at)))


def counts(items: Column) -> Column:
    """The different elements with their counts as (less: the count below zero, item), the most frequent first, then in order
    of the element. The elements are sorted, so the work stays near their number."""
    def bound(value: Column, use) -> Column:  # what stands in a lambda is computed again for each element, a lambda's argument is not
        return F.element_at(F.transform(F.array(value), use), 1)

    def runs(s: Column, starts: Column) -> Column:
        return F.transform(starts, lambda at, i: F.struct(
            (at - F.coalesce(F.get(starts, i + 1), F.size(s))).cast("bigint").alias("less"), F.get(s, at).alias("item")))

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda at: (at == 0) | (F.get(s, at) != F.get(s, at - 1)))
        return F.when(F.size(s) > 0, F.sort_array(bound(starts, lambda f: runs(s, f))))

    return bound(F.sort_array(items), counted)


def analysis_text(title: Column, description: Column, content: Column, max_content: int | None = None) -> Column:
    """Title twice, description, content; missing parts leave no blank.

    The whole content counts. With ``max_content``, longer content is cut and marked with three dots, for
    comparison with scores that were made that way.
    """
    body = content
    if max_content is not None:
        cut = F.concat(F.substring(content, 1, max_content), F.lit("..."))
        body = F.when(F.length(content) > max_content, cut).otherwise(content)
    empty_to_null = [F.nullif(part, F.lit("")) for part in (title, title, description, body)]
    return F.concat_ws(" ", *empty_to_null)
