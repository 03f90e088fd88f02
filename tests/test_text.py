import re
import unicodedata

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import text as X
from cohortspark.operators import tfidf as TI

GOLDEN = {
    "Hx of CA, 2.5 cm; well-differentiated.": "history of carcinoma 2.5 cm well-differentiated.",
    "CA 19-9 / ca_125 / CA-125": "carcinoma 19-9 ca 125 carcinoma-125",
    "Printed on 01/02\nMargins clear": "margins clear",
    "Printed on 01/02\rMargins clear": "",
    "This report was generated by X\nok": "ok",
    "Copy No. 3 Page 1 / 2 tail": "tail",
    "éca ca": "ca carcinoma",
    "Page 3\xa0/ 4 x": "x",
    "adenoca adenoca\U0001fbf0adenoca": "adenocarcinoma adenoca adenoca",
    "ca \U0001d400ca ca\U0001d400 \U0001f600ca": "carcinoma ca ca carcinoma",
    "   ": "",
    "nan": "nan",
}


def is_word(c):
    return c.isalnum() or c == "_"


def expanded(text):
    """Whole words of the list replaced, longest runs of word characters first cut out by a scan."""
    out, at = [], 0
    phrases = sorted(C.MEDICAL_ABBREVIATIONS, key=len, reverse=True)
    while at < len(text):
        free = at == 0 or not is_word(text[at - 1])
        hit = next(
            (p for p in phrases if free and text.startswith(p, at) and not is_word(text[at + len(p) : at + len(p) + 1] or " ")), None
        )
        out.append(C.MEDICAL_ABBREVIATIONS[hit] if hit else text[at])
        at += len(hit) if hit else 1
    return "".join(out)


def cleaned(text):
    """What cleaning must give, by a scan over characters instead of substitutions."""
    text = expanded(text.lower())
    for pattern in C.BOILERPLATE_PATTERNS:
        found, kept, at = re.compile(pattern, re.IGNORECASE), [], 0
        while at < len(text):
            m = found.match(text, at)
            kept.append("" if m else text[at])
            at = m.end() if m else at + 1
        text = "".join(kept)
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789.-" else " " for c in text).split())


def apply(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


def test_golden_cleaning(spark):
    assert apply(spark, GOLDEN, X.clean_text) == list(GOLDEN.values())
    assert [cleaned(t) for t in GOLDEN] == list(GOLDEN.values())
    assert apply(spark, [None], X.clean_text) == [""]


def test_minimal_cleaner_expands_nothing(spark):
    assert apply(spark, ["Hx of CA, page 1/2", None], X.clean_text_min) == ["hx of ca page 1 2", ""]


PIECES = st.sampled_from(
    [*C.MEDICAL_ABBREVIATIONS, "Printed on", "Page 3/4", "copy no. 7", "End of Report", "PATHOLOGY REPORT", "page 2",
     "report generated", "electronıc ſignature", "\n", "\r", "\x1c", "\xa0", " ", " ", "_", "-", ".", "é", "ß", "²", "中", "́", "٣", "CA"]
)
TEXTS = st.lists(PIECES | st.text(max_size=4), max_size=12).map(lambda parts: " ".join(parts[::2]) + "".join(parts[1::2]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.explicit, Phase.generate])
@given(st.lists(TEXTS, min_size=40, max_size=40))
def test_cleaning_equals_python(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    assert apply(spark, values, X.clean_text) == [cleaned(v) for v in values]


def test_nonempty(spark):
    values = [None, "", " \t\n\xa0　", "nan", "NaN", "x", " x "]
    assert apply(spark, values, X.is_nonempty_text)[1:] == [False, False, False, True, True, True]


def test_words(spark):
    assert apply(spark, [None, "", "  a b \n c "], X.words) == [[], [], ["a", "b", "c"]]
    assert apply(spark, [None, "a  b c"], lambda c: X.truncate_words(c, 2)) == ["", "a b"]


def test_tokens(spark):
    text = "margin. t.n t. er-positive 1a2 3-cm a g3."
    assert apply(spark, [text], X.tokens) == [["margin", "t.n", "er-positive", "cm", "g3"]]


def test_ngrams(spark):
    df = spark.createDataFrame([("aa bb cc dd",), ("aa",), ("",)], "t string")
    got = [r.grams for r in TI.with_ngrams(df, "t").collect()]
    assert got[0] == ["aa", "bb", "cc", "dd", "aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd"]
    assert got[1:] == [["aa"], []]


def test_gene_flag_is_whole_word(spark):
    values = ["KRAS|TP53", "NKRAS", "KRAS1", None, "A|KRAS", "\U0001d400KRAS", "KRAS\U0001d400", "\U0001f600KRAS"]
    assert apply(spark, values, lambda c: X.has_gene(c, "KRAS")) == [1, 0, 0, 0, 1, 0, 0, 1]


def test_strip_accents(spark):
    values = ["plain", "Éclair ﬁn ½", "ñ中ü", None, ""]
    expected = [
        v and "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values
    ]
    assert apply(spark, values, X.strip_accents) == expected


@pytest.mark.parametrize("pattern", C.BOILERPLATE_PATTERNS)
def test_case_folding_covers_both_odd_letters(spark, pattern):
    assert "{" not in X.boilerplate_regex(pattern).replace(X.SPACE, "").replace(X.DIGIT, "")


def test_what_is_dropped_is_a_positive_class_and_the_same_for_every_character(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "a".join(chars[i : i + 4096]) for i in range(0, len(chars), 4096)]
    df = spark.createDataFrame(enumerate(texts), "i int, t string")
    squashed = X._squash(F.col("t"))
    got = [r[0] for r in df.select("i", squashed.alias("s")).orderBy("i").select("s").collect()]
    assert got == [re.sub(r"[^a-z0-9.\-]+", " ", t).strip(" ") for t in texts]
    # Java tests a negated class of ranges and single characters about ten times as slowly
    assert "[^" not in df.select(X.clean_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
