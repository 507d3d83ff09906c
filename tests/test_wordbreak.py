"""Word boundaries against cases of the rules and against the rules applied one by one."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions.wordbreak import WORD_LIKE, WORD_PATTERN, segments, words_uax29

#: Text with "|" at its inner boundaries; rule by rule.
CASES = [
    "a|\r\n|b", "a|\r|\u0308|b", "a|\n|\n|b", "a|\x85|\u0308",                       # WB3, 3a, 3b
    "\U0001F6D1\u200D\U0001F6D1", "a\u200D\U0001F6D1", "\u2701\u200D\u2701",          # WB3c
    "\U0001F476\U0001F3FF|\U0001F476", "\U0001F476\U0001F3FF\u0308\u200D\U0001F476\U0001F3FF",
    "a|   |b", "a| \u0308| |b",                                                       # WB3d
    "a\u0308\u200Db", "\u0308|a", "a\u00ADb",                        # WB4
    "hello| |world", "can't| |stop", "a.b.c|.", "a|'|'|b", "a|:|1", "a:b", "a|,|b",   # WB5 to 7
    "\u05D0'", "\u05D0'\u05D0", "\u05D0'|1", "\u05D0\"\u05D0", "\u05D0|\"", "\u05D0|\"|a", "a\u05D0'|_", # WB7a to 7c
    "3.14", "1,000|.", "3a", "a3", "1|:|1", "1|,|a", "1|.| |2", "1.2,3;4",            # WB8 to 12
    "\u30AB\u30BF", "\u30AB|a", "a|\u30AB", "\u30AB_a", "\u30AB\u30FC\u30AB",         # WB13
    "_a_1_", "a__b", "__", "1_\u30AB_",                                               # WB13a, 13b
    "\U0001F1E6\U0001F1E7|\U0001F1E8", "\U0001F1E6\U0001F1E7|\U0001F1E8\U0001F1E9|a", # WB15, 16
    "\u65E5|\u672C", "\u3072|\u3089", "\u0E01|\u0E02", "a|!|?", "l\u2019imp\u00F4t",  # WB999
]


def split(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.s for r in df.select("i", segments("t").alias("s")).orderBy("i").collect()]


def test_cases(spark):
    got = split(spark, [c.replace("|", "") for c in CASES])
    assert ["|".join(g) for g in got] == CASES


#: Code points of every class, by class.
CLASSES = {
    "letter": "ab\u00e9\U00010400", "hebrew": "\u05d0\u05d1", "digit": "19\u0663", "wide": "\uff10",
    "kana": "\u30ab\u30fc", "connector": "_", "single": "'", "double": '"', "both": ".\u2019", "mid_letter": ":\u00b7",
    "mid_digit": ",;\u066c", "cr": "\r", "lf": "\n", "newline": "\x85\x0b\u2028", "blank": " \u3000", "extend": "\u0308\u00ad\U0001f3ff\u0903",
    "zwj": "\u200d", "region": "\U0001f1e6\U0001f1e7", "pict": "\U0001f6d1\u2701\u00a9", "other": "!-/\t\u3042\u65e5\u0e01\U00020000",
}
CLASS_OF = {c: k for k, members in CLASSES.items() for c in members}


def by_rules(text):
    """The segments, each place between two code points judged by the rules in turn."""
    c = ["digit" if CLASS_OF[x] == "wide" else CLASS_OF[x] for x in text]
    line, cling = ("cr", "lf", "newline"), ("extend", "zwj")
    letters, strong = ("letter", "hebrew"), ("letter", "hebrew", "digit", "kana", "connector")

    def base(j):
        """Where the code point is that those at ``j`` and before cling to."""
        while j > 0 and c[j] in cling and c[j - 1] not in line:
            j -= 1
        return j

    def at(j):
        return c[j] if 0 <= j < len(c) else None

    def joined(i):
        a, b = c[i - 1], c[i]
        if (a, b) == ("cr", "lf"):
            return True
        if a in line or b in line:
            return False
        if (a, b) in (("zwj", "pict"), ("blank", "blank")) or b in cling:
            return True
        p1 = base(i - 1)
        p2 = base(p1 - 1) if p1 else -1
        n2 = i + 1
        while at(n2) in cling:
            n2 += 1
        a, before, after = c[p1], at(p2), at(n2)
        middle = ("mid_letter", "both", "single")
        number = ("mid_digit", "both", "single")
        regions, j = 0, p1
        while j >= 0 and c[j] == "region":
            regions, j = regions + 1, (base(j - 1) if j else -1)
        return (a in letters and b in letters
                or a in letters and b in middle and after in letters
                or before in letters and a in middle and b in letters
                or a == "hebrew" and b == "single"
                or a == "hebrew" and b == "double" and after == "hebrew"
                or before == "hebrew" and a == "double" and b == "hebrew"
                or a == b == "digit" or a in letters and b == "digit" or a == "digit" and b in letters
                or before == "digit" and a in number and b == "digit"
                or a == "digit" and b in number and after == "digit"
                or a == b == "kana"
                or a in strong and b == "connector" or a == "connector" and b in strong
                or a == b == "region" and regions % 2 == 1)

    cuts = [0, *[i for i in range(1, len(text)) if not joined(i)], len(text)]
    return [text[a:z] for a, z in zip(cuts, cuts[1:])]


def test_rules_give_the_cases():
    for case in CASES:
        text = case.replace("|", "")
        if set(text) <= set(CLASS_OF):
            assert "|".join(by_rules(text)) == case


@pytest.mark.parametrize("kinds", [list(CLASSES), ["letter", "hebrew", "single", "double", "extend", "connector", "digit"],
                                   ["kana", "connector", "letter", "both", "digit", "mid_digit"],
                                   ["zwj", "pict", "region", "letter", "blank", "lf", "extend"]])
def test_against_the_rules(spark, kinds):
    r = random.Random(len(kinds))
    texts = ["".join(r.choice(CLASSES[r.choice(kinds)]) for _ in range(r.randrange(1, 15))) for _ in range(8000)]
    bad = [(t, g, w) for t, g, w in zip(texts, split(spark, texts), map(by_rules, texts)) if g != w]
    assert not bad, (len(bad), [tuple(map(ascii, x)) for x in bad[:6]])


def test_words(spark):
    text = "The l\u2019IMP\u00D4T of 10,000_l: \u65E5\u672C \u30AB\u30BF\u30AB\u30CA \U0001F1E9\U0001F1EA \U0001F476\U0001F3FF -- don't!"
    df = spark.createDataFrame([(text,), (None,), ("",), (" \n--",)], "t string")
    got = [r.w for r in df.select(words_uax29("t").alias("w")).collect()]
    assert got == [["the", "l\u2019imp\u00F4t", "of", "10,000_l", "\u65E5", "\u672C", "\u30AB\u30BF\u30AB\u30CA", "don't"], None, [], []]
    both = df.select(words_uax29("t", pictographs=True).alias("w")).first().w
    assert both[-3:] == ["\U0001F1E9\U0001F1EA", "\U0001F476\U0001F3FF", "don't"]


@pytest.mark.parametrize("kinds", [list(CLASSES), ["letter", "plain", "both", "mid_letter", "mid_digit", "digit", "blank", "extend"],
                                   ["plain", "ascii", "single", "connector", "extend", "lf", "hebrew", "zwj", "pict"]])
def test_words_are_the_word_like_segments(spark, kinds):
    classes = CLASSES | {"plain": "azAZ09\u00e9\u00df\u0153", "ascii": "".join(map(chr, range(128)))}
    r = random.Random(len(kinds))
    texts = ["".join(r.choice(classes[r.choice(kinds)]) for _ in range(r.randrange(1, 25))) for _ in range(8000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", words_uax29("t").alias("w"), F.filter(segments(F.lower("t")), lambda x: x.rlike(WORD_LIKE)).alias("s"))
    bad = [(r.t, r.w, r.s) for r in df.where("w <> s").collect()]
    assert not bad, (len(bad), [tuple(map(ascii, x)) for x in bad[:6]])


def test_only_words_are_put_out_of_plain_text(spark):
    """Blanks and marks of plain text are passed over: one entry a word, and two for the end."""
    text = "(l'un) \u00e9tait, 3.5 fois; \"vu\" - donc...\r\n" * 50
    n = F.size(F.regexp_extract_all("t", F.lit(WORD_PATTERN), F.lit(1)))
    assert spark.createDataFrame([(text,)], "t string").select(n).first()[0] == 6 * 50 + 2


def test_a_long_text_is_whole(spark):
    text = ("word " * 200_000) + "a" * 1_000_000 + "'" * 1000
    got = spark.createDataFrame([(text,)], "t string").select(segments("t").alias("s")).select(
        F.size("s"), F.array_join("s", "") == F.lit(text), F.array_max(F.transform("s", F.length))).first()
    assert tuple(got) == (400_000 + 1 + 1000, True, 1_000_000)
