from pyspark.sql import functions as F

from speechgrid.functions import words as wr
from speechgrid.operators import segment as sg


def test_turns_are_searched_once_a_word(spark):
    assert sg._labels(sg.RULES).count("filter(T, x -> 2 * x.s <= t2 and t2 <= 2 * x.e)") == 1
    assert "exists(T, x -> 2 * x.s <= t2 and t2 <= 2 * x.e)" not in sg._labels(sg.RULES)
    w = [(0, 0, 100), (1, 150, 250), (2, 300, 400), (3, 2000, 2100)]  # in A; in A and B, equally long; in B; after both
    x = spark.createDataFrame([(w, [(0, 250, "A"), (100, 350, "B"), (300, 400, "B")])], "W array<struct<idx:int,s:bigint,e:bigint>>, T array<struct<s:bigint,e:bigint,speaker:string>>")
    assert x.select(F.expr(sg._labels(sg.RULES)).alias("L")).first().L == ["A", "A", "B", "B"]


def test_words_of_letters_need_no_patterns(spark):
    """Flags are those of the patterns for every kind of word, and words of ASCII letters alone skip them."""
    words = "yes Yes YES i I so So And mm twenty Lakh a. A. Mr. e.g. end! ok? I’m i'm don't Éa éa word  word.  xİ अ। 3rd (Ten) «Oh» - , …".split(" ") + ["", "a\u0085"]
    got = sg.word_flags(spark.createDataFrame([(w,) for w in words], "word string"))
    assert "CASE WHEN" in got._jdf.queryExecution().optimizedPlan().toString()
    b, p, lex = wr.bare("word"), wr.plain("word"), wr.LEXICON
    want = {"ends": wr.sentence_end("word"), "soft": F.rlike(b, F.lit("[.…]$")), "clause": wr.clause_end("word"), "marked": wr.marked("word"), "asks": wr.question("word"),
            "shout": F.rlike(b, F.lit("[?!]$")), "opens": wr.opens("word"), "cap": wr.capital("word"), "num": wr.numeric("word"), "bc": p.isin(*lex.backchannels), "filler": p.isin(*lex.fillers),
            "answer": p.isin(*lex.answers), "dangling": p.isin(*lex.dangling), "so": p == "so", "pron": F.split(F.regexp_replace(p, "’", "'"), "'")[0] == "i"}
    bad = got.select("word", F.array(*[F.when(~F.col(k).eqNullSafe(v), F.lit(k)) for k, v in want.items()]).alias("bad")).filter(F.size(F.array_compact("bad")) > 0)
    assert bad.collect() == []
