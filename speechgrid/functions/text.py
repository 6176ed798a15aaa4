"""Text measures as column expressions: Telugu aksharas, English syllables, spoken numbers, script shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Telugu letter classes, spoken numerals and their scales, Latin letters, clock and currency words.
CONSONANT = "[\\u0C15-\\u0C39\\u0C58-\\u0C5A\\u0C5D]"
VOWEL = "[\\u0C05-\\u0C14\\u0C60\\u0C61]"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
TELUGU_DIGITS = "౦౧౨౩౪౫౬౭౮౯"
UNITS = ("సున్నా ఒకటి రెండు మూడు నాలుగు ఐదు ఆరు ఏడు ఎనిమిది తొమ్మిది పది పదకొండు పన్నెండు పదమూడు పద్నాలుగు పదిహేను పదహారు "
         "పదిహేడు పద్దెనిమిది పందొమ్మిది").split()
TENS = "ఇరవై ముప్పై నలభై యాభై అరవై డెబ్బై ఎనభై తొంభై".split()
HUNDRED = ("వంద", "నూట", "వందలు", "వందల")          # exactly 100, 1xx, exactly n hundred, n hundred and more
THOUSAND = ("వెయ్యి", "వేలు", "వేల")               # one, many exactly, many and more
LAKH = ("లక్ష", "లక్షలు", "లక్షల")
CRORE = ("కోటి", "కోట్లు", "కోట్ల")
POINT, PERCENT = "పాయింట్", "శాతం"
CURRENCY = {"₹": "రూపాయలు", "rs": "రూపాయలు", "inr": "రూపాయలు", "$": "డాలర్లు", "usd": "డాలర్లు", "€": "యూరోలు", "£": "పౌండ్లు"}
NUMBER = "\\d[\\d,]*(?:\\.\\d+)?"
MONEY = "(?:₹|\\$|€|£|\\b(?:rs\\.?|inr|usd)\\s?)\\s?"
# End of fixed values.

_WORDS_0_99 = "|".join(UNITS + [t if r == 0 else f"{t} {UNITS[r]}" for t in TENS for r in range(10)])


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def let(value: Column, fn) -> Column:
    """``fn`` of ``value``, evaluated once: the start value of a fold over nothing, and ``fn`` its finish. (The element of an array mapped by
    ``fn`` is the same, but is copied with all it holds, and the type of ``fn`` is worked out anew for every row.)"""
    return F.aggregate(F.array(), value, lambda so_far, _: so_far, fn)


def count_aksharas(text, pollu: float = 0.5) -> Column:
    """Aksharas of Telugu text: independent vowels, and consonants no virama joins to one before; less a half for each virama
    no consonant follows. A joiner between virama and consonant is transparent."""
    t = _c(text)
    joined = F.regexp_count(t, F.lit(f"\\u0C4D\\u200D?(?={CONSONANT})"))
    n = F.regexp_count(t, F.lit(VOWEL)) + F.regexp_count(t, F.lit(CONSONANT)) - joined
    dead = F.regexp_count(t, F.lit("\\u0C4D")) - joined
    return F.greatest(n - (1 - pollu) * dead, F.lit(0.0))


def english_syllables(word) -> Column:
    """Syllables of one English word: vowel groups with silent -e, -es and -ed; short words are one."""
    w = F.regexp_replace(F.lower(_c(word)), "^'+|'+$", "")
    g = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = ((F.rlike(w, F.lit("e$")) & ~F.rlike(w, F.lit("(?:le|ee|ye)$")))
              | (F.rlike(w, F.lit("e[sd]$")) & ~F.rlike(w, F.lit("(?:ted|ded|ses|zes|ces|ges|xes)$"))))
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(g - F.when(silent & (g > 1), 1).otherwise(0), F.lit(1)))


def text_syllables(text) -> Column:
    """Syllables of the Latin words of a text."""
    ws = F.regexp_extract_all(_c(text), F.lit("[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0))
    return F.aggregate(ws, F.lit(0), lambda a, w: a + english_syllables(w).cast("int"))


def _below_100(n: Column) -> Column:
    return F.get(F.split(F.lit(_WORDS_0_99), "\\|"), n.cast("int"))


def _scaled(v: Column, unit: int, words: tuple[str, str, str], many, rest) -> Column:
    """How many units (if any), then what is left (if anything, or if there was no unit)."""
    one, plural, joiner = words

    def say(x: Column) -> Column:
        units = F.when(x["q"] == 1, F.lit(one)).when(x["q"] > 1, F.concat_ws(" ", many(x["q"]), F.when(x["r"] == 0, F.lit(plural)).otherwise(F.lit(joiner))))
        return F.concat_ws(" ", units, F.when((x["r"] > 0) | (x["q"] == 0), rest(x["r"])))
    return let(F.struct(F.floor(v / F.lit(unit)).cast("bigint").alias("q"), F.pmod(v, F.lit(unit)).cast("bigint").alias("r")), say)


def number_words(n) -> Column:
    """Spoken Telugu of a whole number of any length, given as a number or as its digits (Indian grouping)."""
    def below_1000(v: Column) -> Column:
        one, one_more, many, many_more = HUNDRED

        def say(x: Column) -> Column:
            hundreds = (F.when(x["h"] == 1, F.when(x["r"] == 0, F.lit(one)).otherwise(F.lit(one_more)))
                        .when(x["h"] > 1, F.concat_ws(" ", _below_100(x["h"]), F.when(x["r"] == 0, F.lit(many)).otherwise(F.lit(many_more)))))
            return F.concat_ws(" ", hundreds, F.when((x["r"] > 0) | (x["h"] == 0), _below_100(x["r"])))
        return let(F.struct(F.floor(v / F.lit(100)).alias("h"), F.pmod(v, F.lit(100)).alias("r")), say)

    def below_crore(v: Column) -> Column:
        return _scaled(v, 100_000, LAKH, _below_100, lambda r: _scaled(r, 1_000, THOUSAND, _below_100, below_1000))

    # Groups of seven digits from the right; each step says what stands before as so many crores, then the group.
    digits = F.lpad(_c(n).cast("string"), (F.ceil(F.length(_c(n).cast("string")) / 7) * 7).cast("int"), "0")
    groups = F.transform(F.sequence(F.lit(0), (F.length(digits) / 7).cast("int") - 1), lambda k: F.substr(digits, k * 7 + 1, F.lit(7)).cast("bigint"))
    one, plural, joiner = CRORE

    def step(so_far: Column, group: Column) -> Column:
        crores = F.when(so_far["n"] == 1, F.lit(one)).when(so_far["n"] > 1, F.concat_ws(" ", so_far["said"], F.when(group == 0, F.lit(plural)).otherwise(F.lit(joiner))))
        return F.struct(F.concat_ws(" ", crores, F.when((group > 0) | (so_far["n"] == 0), below_crore(group))).alias("said"),
                        F.when(so_far["n"] == 0, F.least(group, F.lit(2))).otherwise(F.lit(2)).cast("bigint").alias("n"))
    return F.aggregate(groups, F.struct(F.lit("").alias("said"), F.lit(0).cast("bigint").alias("n")), step, lambda x: x["said"])


def normalize_numbers(text) -> Column:
    """Digits, currency and percentages as spoken Telugu."""
    t = F.translate(_c(text), TELUGU_DIGITS, "0123456789")
    pat = f"(?i)(?:{MONEY}{NUMBER}|{NUMBER}\\s?%|{NUMBER})"

    def digits(s: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("\\d"), F.lit(0)), lambda d: _below_100(d.cast("int"))), " ")

    def said(tok: Column) -> Column:
        num = F.regexp_extract(tok, NUMBER, 0)
        whole = F.replace(F.regexp_extract(num, "^[\\d,]+", 0), F.lit(","), F.lit(""))
        frac = F.regexp_extract(num, "\\.(\\d+)$", 1)
        words = number_words(F.when(whole != "", F.regexp_replace(whole, "^0+(?=\\d)", "")))
        words = F.when(frac == "", words).otherwise(F.concat_ws(" ", words, F.lit(POINT), digits(frac)))
        sym = F.lower(F.regexp_extract(tok, "^([^\\d\\s.]+)", 1))
        unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv]), sym)
        return F.concat_ws(" ", words, unit, F.when(F.endswith(tok, F.lit("%")), F.lit(PERCENT)))

    gaps = F.split(t, pat, -1)
    nums = F.regexp_extract_all(t, F.lit(pat), F.lit(0))
    joined = F.array_join(F.zip_with(gaps, nums, lambda g, n: F.concat(F.coalesce(g, F.lit("")), F.when(n.isNull(), F.lit("")).otherwise(said(n)))), "")
    done = F.when(F.rlike(t, F.lit("\\d")), joined).otherwise(t)
    return F.trim(F.regexp_replace(done, "\\s{2,}", " "))


def spoken_units(text) -> Column:
    """Speaking length of a Telugu line, its digits spoken."""
    return let(normalize_numbers(text), lambda t: count_aksharas(t))


def mixed_units(text) -> Column:
    """Aksharas plus the syllables of Latin words."""
    return let(normalize_numbers(text), lambda t: count_aksharas(t) + text_syllables(t))


def latin_ratio(text) -> Column:
    """Share of words in Latin script among Latin and Telugu words."""
    lat = F.regexp_count(_c(text), F.lit(f"[{LATIN}][{LATIN}'’-]*"))
    tel = F.regexp_count(_c(text), F.lit("[\\u0C00-\\u0C7F]+"))
    return F.when(lat + tel > 0, lat / (lat + tel)).otherwise(0.0)
