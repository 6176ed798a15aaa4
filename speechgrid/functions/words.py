"""Word rules: sentence and clause ends, openings, names, numbers, backchannels. All are column expressions.

The lists below are inputs: every operator that reads them takes a ``Lexicon``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these marks and words being exactly these.
SENTENCE_MARKS = ".?!…।"
CLAUSE_MARKS = ",;:—-"
CLOSERS = "\"')]}»”’"
TRAILING_MARKS = ".,?!;:…"
ABBREVIATIONS = ("mr. mrs. ms. mx. dr. prof. st. vs. jr. sr. e.g. i.e. approx. cf. fig. gen. gov. sen. capt. lt. sgt."
                 ).split()
BACKCHANNELS = "yeah yes yep mm mhm mm-hmm uh-huh right okay ok hmm uh um ah oh wow".split()
FILLERS = "mm mhm mm-hmm uh-huh hmm uh um".split()
ANSWERS = "yeah yes yep mhm mm-hmm uh-huh right okay ok".split()
DANGLING = "and but or because the a an if than my your our their".split()
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
                "billion trillion lakh lakhs crore crores point percent dozen").split()
# End of fixed values.


@dataclass(frozen=True)
class Lexicon:
    abbreviations: tuple[str, ...] = tuple(ABBREVIATIONS)
    backchannels: tuple[str, ...] = tuple(BACKCHANNELS)
    fillers: tuple[str, ...] = tuple(FILLERS)
    answers: tuple[str, ...] = tuple(ANSWERS)
    dangling: tuple[str, ...] = tuple(DANGLING)
    number_words: tuple[str, ...] = tuple(NUMBER_WORDS)


LEXICON = Lexicon()


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def bare(word) -> Column:
    """The word without closing quotes and brackets."""
    return F.regexp_replace(_c(word), "[\"')\\]}»”’]+$", "")


def core(word) -> Column:
    """Lower-cased, letters, digits and apostrophes only."""
    return F.regexp_replace(F.lower(_c(word)), "[^\\p{L}\\p{M}\\p{N}_']+", "")


def plain(word) -> Column:
    """Lower-cased without sentence marks at either end."""
    return F.regexp_replace(F.lower(_c(word)), "^[.,!?]+|[.,!?]+$", "")


def opens(word) -> Column:
    """The word may open a sentence: its first letter or digit is not lower-case."""
    return ~F.rlike(_c(word), F.lit("^[^\\p{L}\\p{N}]*\\p{Ll}"))


def capital(word) -> Column:
    return F.rlike(_c(word), F.lit("^[^\\p{L}\\p{N}]*\\p{Lu}"))


def sentence_end(word, nxt=None, lex: Lexicon = LEXICON) -> Column:
    """``word`` ends a sentence before the word ``nxt`` (NULL: nothing follows)."""
    b = bare(word)
    ends = F.rlike(b, F.lit("[.?!…।]$")) & ~F.lower(b).isin(*lex.abbreviations)
    if nxt is None:
        return ends
    n = _c(nxt)
    return ends & (n.isNull() | ~F.rlike(b, F.lit("[.…]$")) | opens(n))


def clause_end(word) -> Column:
    return F.rlike(bare(word), F.lit("[,;:—-]$"))


def marked(word) -> Column:
    return F.rlike(bare(word), F.lit("[.?!…।,;:—-]$"))


def question(word) -> Column:
    return F.rlike(bare(word), F.lit("[?]$"))


def numeric(word, lex: Lexicon = LEXICON) -> Column:
    t = F.regexp_replace(F.lower(_c(word)), "^[.,!?;:\"'()$%₹€£]+|[.,!?;:\"'()$%₹€£]+$", "")
    return F.rlike(t, F.lit("\\p{Nd}")) | t.isin(*lex.number_words)


def is_backchannel_word(word, lex: Lexicon = LEXICON) -> Column:
    return plain(word).isin(*lex.backchannels)
