"""Text measures as Columns: entropy, readability of labels, look-alikes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: characters that pass for others ------------------------------
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "０": "0", "１": "1", "ѕ": "s", "ⅰ": "i",
}
COMBINED = [("rn", "m"), ("vv", "w")]
# -------------------------------------------------------------------------------


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over characters; 0 for the empty text.

    Counts by length differences, so the cost is distinct characters times
    length, without a shuffle.
    """
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))

    def part(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.transform(chars, part), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def consonant_run_ratio(label: Column) -> Column:
    """Longest run of four or more consonants over the label's length."""
    letters = F.regexp_replace(F.lower(label), "[^a-z]", "")
    runs = F.transform(F.regexp_extract_all(letters, F.lit("([^aeiou]{4,})"), F.lit(1)), F.length)
    return F.when(F.length(letters) > 0, F.coalesce(F.array_max(runs), F.lit(0)) / F.length(letters)).otherwise(0.0)


def trigrams(word: Column) -> Column:
    """Distinct character trigrams of ^word$."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def linguistic_score(label: Column, known: list[str]) -> Column:
    """Share of the label's trigrams that the corpus has; 0.5 under three letters."""
    letters = F.regexp_replace(F.lower(label), "[^a-z]", "")
    grams = trigrams(letters)
    corpus = F.array(*[F.lit(g) for g in known])
    hits = F.size(F.filter(grams, lambda g: F.array_contains(corpus, g)))
    return F.when(F.length(letters) < 3, 0.5).otherwise(hits / F.size(grams))


def normalise_homoglyphs(text: Column) -> Column:
    out = F.translate(text, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))
    for old, new in COMBINED:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def redact(secret: Column) -> Column:
    """The first 8 and last 4 of its first 80 characters; of a secret of 12 or
    fewer, which these would show whole, the first 4 alone."""
    shown = F.left(secret, F.lit(80))
    ends = F.concat(F.left(shown, F.lit(8)), F.lit("***"), F.right(shown, F.lit(4)))
    return F.when(F.length(shown) > 12, ends).otherwise(F.concat(F.left(shown, F.lit(4)), F.lit("***")))


def osa_distance(a: Column, b: Column, limit: int = 3, beyond: int = 99) -> Column:
    """The optimal-string-alignment distance (a swap of neighbours costs one, and
    no part is edited twice) up to a limit; above it, ``beyond``.

    A fold over the letters of a that keeps the last two rows of the alignment
    table, of which only the band of cells within the limit of the diagonal is
    held; every cell outside counts as more than the limit.
    """
    width, more = 2 * limit + 1, limit + 1
    letters = F.filter(F.split(a, ""), lambda c: c != "")
    here = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k >= limit, k - limit).otherwise(F.lit(more)))
    far = F.array_repeat(F.lit(more), width)
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("last"), far.alias("old"), here.alias("row"))

    def step(state: Column, letter: Column) -> Column:
        i, old, row = state["i"] + 1, state["old"], state["row"]

        def cell(left: Column, k: Column) -> Column:
            # column j of this row; k is its place in the band
            j = i + k - limit
            other, before = F.substring(b, j, F.lit(1)), F.substring(b, j - 1, F.lit(1))
            drop = F.coalesce(F.get(row, k + 1), F.lit(more)) + 1
            add = F.coalesce(F.get(left, k - 1), F.lit(more)) + 1
            change = F.get(row, k) + F.when(other == letter, 0).otherwise(1)
            swap = F.when((i > 1) & (j > 1) & (other == state["last"]) & (before == letter), F.get(old, k) + 1).otherwise(F.lit(more))
            inside = F.when(j == 0, i).otherwise(F.least(drop, add, change, swap))
            return F.concat(left, F.array(F.when((j < 0) | (j > F.length(b)), F.lit(more)).otherwise(F.least(inside, F.lit(more)))))

        new = F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.array().cast("array<int>"), cell)
        return F.struct(i.alias("i"), letter.alias("last"), row.alias("old"), new.alias("row"))

    def last(state: Column) -> Column:
        return F.coalesce(F.get(state["row"], F.length(b) - state["i"] + limit), F.lit(more))

    close = F.abs(F.length(a) - F.length(b)) <= limit
    found = F.when(close, F.aggregate(letters, start, step, last))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(found <= limit, found).otherwise(F.lit(beyond))


def within_osa(a: Column, b: Column, limit: int) -> Column:
    """Whether the optimal-string-alignment distance is 1..limit, for limit 2.

    Natively: a transposition costs Levenshtein two, so distances up to four
    there cover it; each single swap of neighbours in ``a`` is tried.
    """
    swaps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))),
    )
    plain = F.levenshtein(a, b, 4)  # -1 above four
    swapped = 1 + F.array_min(F.transform(swaps, lambda s: F.levenshtein(s, b)))
    return F.when(plain >= 0, F.least(plain, swapped).between(1, limit)).otherwise(False)
