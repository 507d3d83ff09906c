"""Stopword tables.

``custom_stopwords`` is the analysis' own list; ``builtin_stopwords`` is Spark ML's list for
a language. Both are small literal tables (tens to hundreds of rows, fixed by the code), which
the planner broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The analysis' custom stopword list, as written (lower-cased on load).
CUSTOM_STOPWORDS = [
    "2", "4", "100", "1000", "8", "10", "720", "1883", "1878", "1873", "1880", "1879", "0",
    "1882", "1884", "pp", "4_I", "4_l", "100_l", "1000_l", "8_s", "720_s", "10_s", "3_l",
    "720_l", "10,000_l", "50_l", "_on", "metamorphosis", "tokens", "qrs", "5_l", "2000_l",
    "5000_l", "whilst", "laborers", "labourers", "8_d", "g", "etc", "l", "20,000_l", "..a...",
    "1870", "8vo", "900_l", "9_s", "4_s", "2_s", "200_l", "1,000", "laboring", "laborer",
    "labourer",
]

# Spark ML's default English stopword list (StopWordsRemover, "english"),
# kept here so the SQL oracle can use it without a JVM; a test checks it against Spark.
SPARK_ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don
should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's
when's where's who's why's would
""".split()


def word_table(spark: SparkSession, words) -> DataFrame:
    """The words as a table that joins broadcast: the planner does not know its size and would shuffle all tokens first."""
    rows = sorted({w.lower() for w in words})
    return F.broadcast(spark.createDataFrame([(w,) for w in rows], "word string"))


def custom_stopwords(spark: SparkSession, more: tuple = ()) -> DataFrame:
    """The analysis' list and the caller's own words."""
    return word_table(spark, [*CUSTOM_STOPWORDS, *more])


def builtin_stopwords(spark: SparkSession, language: str = "english") -> DataFrame:
    """Spark ML's default stopword list for ``language`` as a one-column table."""
    from pyspark.ml.feature import StopWordsRemover

    return word_table(spark, StopWordsRemover.loadDefaultStopWords(language))

